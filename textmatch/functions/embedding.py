"""Vectors of texts without a trained model: hashed features and a sparse random projection, both fixed by a seed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

WORD = re.compile("[a-z0-9]+")


def features(text: str) -> list[str]:
    """Lower-cased words, and runs of three characters of each word with a mark at both its ends."""
    words = WORD.findall(text.lower())
    return words + [f"_{w}_"[i : i + 3] for w in words for i in range(len(w))]


def hash_projection(dims: int = 64, spread: int = 4, seed: str = "p", unit: bool = True) -> Callable[[list[str]], list[list[float]]]:
    """A callable from texts to vectors of dims numbers.

    Every feature has `spread` places and signs, drawn from an MD5 of the seed and the feature: four hexadecimal digits
    each, the remainder by dims being the place and the parity of the quotient the sign. A text's vector is the sum over its
    features, scaled to length one if unit (that of a text without features is zero). Texts that share words or parts
    of words are near each other, as random projections keep inner products up to noise.
    """
    if not 0 < spread <= 8:
        raise ValueError("1 to 8 places a feature")

    @lru_cache(maxsize=100_000)
    def places(feature: str) -> tuple[tuple[int, int], ...]:
        digest = hashlib.md5(f"{seed}:{feature}".encode()).hexdigest()
        numbers = [int(digest[4 * i : 4 * i + 4], 16) for i in range(spread)]
        return tuple((n % dims, 1 - 2 * (n // dims % 2)) for n in numbers)

    def one(text: str) -> list[float]:
        out = [0] * dims
        for feature in features(text):
            for place, sign in places(feature):
                out[place] += sign
        norm = sum(x * x for x in out) ** 0.5 if unit else 1
        return [x / norm if norm else 0.0 for x in out]

    return lambda texts: [one(t) for t in texts]
