"""Runs of words in the lines of a key, counted and told apart as numbers where the lines are."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from textmatch.functions.text import PROTECTED_ANY_CASE, PROTECTED_BY_CASE

#: Characters of the lines that are worked on at once, about; a key with more is taken whole.
CHARS = 1 << 21
#: Patterns of protected tokens by what a line must hold for them to be tried there: these characters, words or capitals.
PROTECTED = [re.compile(p, re.ASCII) for p in (*PROTECTED_ANY_CASE, *PROTECTED_BY_CASE)]
JOINED, WORDED, NUMBERED, CASED = dict(zip("&./", PROTECTED, strict=False)), PROTECTED[3], PROTECTED[4], PROTECTED[5:]
NUMBER, INNER_CAPITAL = re.compile(r"[-\s][0-9]"), re.compile("[A-Za-z][A-Z]")


def protected(line: str) -> set[str]:
    """protected_tokens() of a line."""
    tried = [p for c, p in JOINED.items() if c in line]
    low = line.lower()
    if "stack" in low or "source" in low or "end" in low:
        tried.append(WORDED)
    if NUMBER.search(line):
        tried.append(NUMBERED)
    if INNER_CAPITAL.search(line):
        tried += CASED
    return {token for p in tried for m in p.finditer(line) if len(token := m.group(0).lower()) >= 4}


@dataclass
class Words:
    """The words of some keys' lines: text of each and its number among the distinct words (kinds), place of its key in the
    batch (doc), its own place in its line and the number of words from it to the line's end; first word and size of lines."""

    text: np.ndarray
    code: np.ndarray
    kinds: pd.Index
    doc: np.ndarray
    place: np.ndarray
    left: np.ndarray
    lines: list[tuple[int, str]]
    start: np.ndarray
    size: np.ndarray

    def __post_init__(self) -> None:
        self.ids = np.full(len(self.code), -1, dtype=np.int64)
        self.at = np.arange(len(self.code))
        self.said = self.text.tolist()

    def runs(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For one to n words: their number, the places at which a run of so many starts, and a number for its key and words."""
        for size in range(1, n + 1):
            at = self.at[self.left >= size]
            before = self.doc[at] if size == 1 else self.ids[at]
            self.ids[at] = ids = pd.factorize(before * len(self.kinds) + self.code[at + size - 1])[0]
            yield size, at, ids

    def named(self, at: np.ndarray, size: int) -> list[str]:
        return [" ".join(self.said[i : i + size]) for i in at.tolist()]


def _words(lines: list[tuple[int, str]]) -> Words:
    cut = [re.findall("[a-z0-9]+", line.lower()) for _, line in lines]
    size = np.array([len(w) for w in cut], dtype=np.int64)
    text = np.array([w for words in cut for w in words], dtype=object)
    start = np.cumsum(size) - size
    place = np.arange(len(text)) - np.repeat(start, size)
    code, kinds = pd.factorize(text)
    doc = np.repeat(np.array([d for d, _ in lines], dtype=np.int64), size)
    return Words(text, code, pd.Index(kinds, dtype=object), doc, place, np.repeat(size, size) - place, lines, start, size)


def pieces(batch: pd.DataFrame) -> Iterator[Words]:
    """Words of the keys of a batch (column __lines, arrays of lines), some keys at a time."""
    taken: list[tuple[int, str]] = []
    chars = 0
    for doc, lines in enumerate(batch["__lines"]):
        taken += [(doc, line) for line in lines]
        chars += sum(map(len, lines))
        if chars >= CHARS:
            yield _words(taken)
            taken, chars = [], 0
    yield _words(taken)


def _firsts(at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A place of each number."""
    first = np.empty(int(ids.max(initial=-1)) + 1, dtype=np.int64)
    first[ids[::-1]] = at[::-1]
    return first


def _rows(keys: pd.Series, doc: np.ndarray, phrases: list[str], **more: object) -> pd.DataFrame:
    return pd.DataFrame({keys.name: pd.Series(keys.to_numpy(dtype=object)[doc], dtype=object), "phrase": pd.Series(phrases, dtype=object), **more})


def counted(n: int, least: int, technical: str, key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Runs of one to n words that occur least times in the lines of a key, or hold a technical word of their line."""
    word, shape, likely = re.compile("[A-Za-z0-9_]+"), re.compile(technical), re.compile(technical.strip("^$"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words in pieces(batch):
                marks = np.zeros(len(words.code) + 1, dtype=np.int64)
                for (_, line), i, size in zip(words.lines, words.start.tolist(), words.size.tolist(), strict=True):
                    said = {w.lower() for w in word.findall(line) if len(w) >= 4 and shape.match(w)} if likely.search(line) else ()
                    for j in range(i, i + size) if said else ():
                        marks[j + 1] = words.text[j] in said
                marks = np.cumsum(marks)
                for size, at, ids in words.runs(n):
                    if not len(at):
                        continue
                    times = np.bincount(ids)
                    holds = np.bincount(ids, marks[at + size] > marks[at]) > 0
                    kept = np.flatnonzero((times >= least) | holds)
                    first = _firsts(at, ids)[kept]
                    yield _rows(batch[key], words.doc[first], words.named(first, size), n=times[kept])

    return run


def _parts(phrase: str) -> Iterator[str]:
    words = phrase.split(" ")
    for size in range(1, len(words)):
        yield from (" ".join(words[i : i + size]) for i in range(len(words) - size + 1))


def uncovered(phrases: list[str | None]) -> list[bool]:
    """Whether each phrase is no contiguous part of a longer one."""
    words = [p.split(" ") for p in {*phrases} - {None}]
    longer: dict[int, set[tuple[str, ...]]] = {}
    for w in words:
        longer.setdefault(len(w), set()).add(tuple(w))
    sizes, parts = {len(w) for w in words}, set()
    covered: set[tuple[str, ...]] = set()
    for size in range(max(sizes, default=0), 1, -1):  # parts of a part are parts
        covered = {x for w in covered | longer.get(size, set()) for x in (w[1:], w[:-1])}
        if size - 1 in sizes:
            parts |= covered & longer[size - 1]
    return [p is None or tuple(p.split(" ")) not in parts for p in phrases]


def longest(n: int, stop_words: tuple[str, ...], key: str, chunks: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Protected tokens, chunks, and runs of two to n words without stop words at their ends, but for parts of longer ones;
    with single words (made is false) that are none of these and no part of them. Four characters or more.

    A run is part of a longer one if, at one of its occurrences, the nearest word that is no stop word beside it is near
    enough; no longer run is made to find out.
    """
    stops, far, plain = {*stop_words}, 1 << 30, re.compile("[a-z0-9]+(?: [a-z0-9]+)*")

    def gaps(words: Words, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance from each word to the nearest one before it, and behind it, in its line that is no stop word."""
        before = np.maximum.accumulate(np.where(good, words.at, -far)) if len(good) else words.at
        before = np.concatenate([[-far], before])[:-1] if len(good) else before
        behind = np.minimum.accumulate(np.where(good, words.at, far)[::-1])[::-1] if len(good) else words.at
        behind = np.concatenate([behind, [far]])[1:]
        to, by = words.at - before, behind - words.at
        return np.where(to <= words.place, to, far), np.where(by < words.left, by, far)

    def found(words: Words, special: dict[int, set[str]]) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
        good = (np.zeros(len(words.kinds), dtype=bool) if chunks else ~words.kinds.isin(stops))[words.code]  # with chunks no runs are made
        to, by = gaps(words, good)
        own, other = np.where(good, 0, to), np.where(good, 0, by)
        # Special phrases that are runs of words too, by size; those that are part of a longer run; parts of special phrases.
        asked: dict[int, set[tuple[int, str]]] = {}
        for d, some in special.items():
            for p in some:
                if plain.fullmatch(p):
                    asked.setdefault(p.count(" ") + 1, set()).add((d, p))
        inside: set[tuple[int, str]] = set()
        hidden = {d: {x for p in some for x in _parts(p)} for d, some in special.items()}
        told = {d: special[d] | hidden[d] for d in special}
        for size, at, ids in words.runs(n):
            if not len(at):
                continue
            last = at + size - 1
            whole = good[at] & good[last]
            reach = np.where(whole, np.minimum(to[at], by[last]), own[at] + other[last])
            held = np.bincount(ids, reach <= n - size) > 0
            if size in asked:
                leads = words.kinds.isin({p.split(" ", 1)[0] for _, p in asked[size]})
                near = at[leads[words.code[at]] & held[ids]]
                inside.update(asked[size].intersection(zip(words.doc[near].tolist(), words.named(near, size), strict=True)))
            free = (whole if size > 1 else np.ones(len(at), dtype=bool)) & ~held[ids]
            first = at[free][np.unique(ids[free], return_index=True)[1]]
            named = zip(words.doc[first].tolist(), words.named(first, size), strict=True)
            yield size > 1, [(d, p) for d, p in named if len(p) >= 4 and (d not in told or p not in told[d])]
        yield True, [(d, p) for d, some in special.items() for p in some if p not in hidden[d] and (d, p) not in inside]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words in pieces(batch):
                special: dict[int, set[str]] = {}
                for d, line in words.lines:
                    if some := protected(line):
                        special.setdefault(d, set()).update(some)
                for d in {d for d, _ in words.lines} if chunks else ():
                    if some := {c for c in batch["__said"].iloc[d] if len(c) >= 4}:
                        special.setdefault(d, set()).update(some)
                for made, some in found(words, special):
                    yield _rows(batch[key], np.array([d for d, _ in some], dtype=np.int64), [p for _, p in some], made=made)

    return run
