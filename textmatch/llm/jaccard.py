"""N-gram Jaccard self-join: MinHash bands, Bayesian pruning of candidates, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmatch.llm.common import components, lookup_join, stored


@dataclass(frozen=True)
class JaccardConfig:
    """words: per shingle. threshold: as decimal text, so that the exact test is in whole numbers.

    hashes = bands * rows. With 63 hashes in bands of 3, a pair at similarity 0.8 shares no band with a chance of
    (1 - 0.8 ** 3) ** 21 = 3e-7. step hashes are compared at a time; a pair goes once the posterior probability (uniform
    prior) that its similarity reaches the threshold is below tolerance. block (rows) and block_chars (their
    characters) bound what one task compares at once.
    """

    words: int = 5
    threshold: str = "0.8"
    bands: int = 21
    rows: int = 3
    step: int = 21
    tolerance: float = 1e-7
    block: int = 1024
    block_chars: int = 4_000_000
    seed: int = 11

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def least_equal(self) -> list[tuple[int, int]]:
        """(hashes compared, fewest equal ones to go on): posterior P(J >= t | m of n) = P(Bin(n + 1, t) <= m)."""
        t = float(Fraction(self.threshold))
        out = []
        for n in range(self.step, self.hashes + 1, self.step):
            total, m = 0.0, 0
            while (total := total + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < self.tolerance:
                m += 1
            out.append((n, m))
        return out


#: Base of the rolling hash over UTF-8 bytes, odd so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = np.uint64(BASE if kind == "up" else pow(BASE, -1, 1 << 64))
        have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 15) * 2, base, np.uint64)]), dtype=np.uint64)
        _powers[kind] = have
    return have[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normalised(text: str | None) -> bytes:
    """Lower-cased words joined by one space each; words are split at ASCII white space."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())


def shingles(norm: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of that many words; of the whole text if it has fewer, none if empty."""
    if not norm:
        return np.empty(0, np.uint64)
    data = np.frombuffer(norm, np.uint8)
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=prefix[1:])
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [n]])
    k = min(words, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(_mixed((prefix[ends] - prefix[starts]) * _power("down", n)[starts] + (ends - starts).astype(np.uint64)))


def _signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(hashes), 2048):
        best = np.minimum(best, ((hashes[i : i + 2048, None] * a + b) >> np.uint64(32)).min(axis=0))
    return best.astype(np.uint32)


def _signature_of(config: JaccardConfig):
    rng = np.random.default_rng(config.seed)
    a = rng.integers(0, 2**63, config.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, config.hashes, dtype=np.uint64)

    @F.pandas_udf("key binary, sig binary, chars long")
    def sign(texts: pd.Series) -> pd.DataFrame:
        keys, sigs, sizes = [], [], []
        for text in texts:
            norm = normalised(text)
            keys.append(hashlib.blake2b(norm, digest_size=16).digest())
            sigs.append(_signature(shingles(norm, config.words), a, b).tobytes() if norm else None)
            sizes.append(len(norm))
        return pd.DataFrame({"key": keys, "sig": sigs, "chars": sizes})

    return sign


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from frames sorted by group, several in a frame; only the last, unended group waits."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        same = np.ones(len(frame), bool)
        for c in by:
            same &= (frame[c] == frame[c].iloc[-1]).to_numpy()
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut == 0 and held:
            goes_on = all(held[-1][c].iloc[-1] == frame[c].iloc[0] for c in by)
            if goes_on:
                held.append(frame)
                continue
        whole = [*held, frame.iloc[:cut]]
        held = [frame.iloc[cut:]]
        if sum(map(len, whole)):
            yield pd.concat(whole, ignore_index=True)
    if held:
        yield pd.concat(held, ignore_index=True)


def _group_numbers(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    new = np.zeros(len(frame), bool)
    for c in by:
        v = frame[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index connected to each index by the pairs (i, j)."""
    lab = np.arange(n)
    while len(i):
        least = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


#: Columns that name a pair of blocks of one bucket.
GROUP = ["band", "bucket", "i", "j"]


def _pairs(config: JaccardConfig, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that pruning leaves; a pair is met in the first band that its texts share, and in no other."""
    steps = config.least_equal()
    group = _group_numbers(frame, GROUP)
    sig = np.frombuffer(b"".join(frame["sig"]), np.uint32).reshape(len(frame), config.hashes)
    band, home = frame["band"].to_numpy(), frame["home"].to_numpy()
    cross = (frame["i"] != frame["j"]).to_numpy()
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, len(frame)):
        at = np.flatnonzero(group[d:] == group[:-d])
        if not len(at):
            break
        at = at[~cross[at] | (home[at] != home[at + d])]  # pairs inside one block meet in the block's own group
        equal, done = np.zeros(len(at), np.int32), 0
        for n, least in steps:
            equal += (sig[at, done:n] == sig[at + d, done:n]).sum(axis=1, dtype=np.int32)
            keep = equal >= least
            at, equal, done = at[keep], equal[keep], n
        if len(at):
            shared = (sig[at] == sig[at + d]).reshape(len(at), config.bands, config.rows).all(axis=2)
            at = at[shared.any(axis=1) & (shared.argmax(axis=1) == band[at])]
            left.append(at)
            right.append(at + d)
    return np.concatenate(left), np.concatenate(right)


def _survivors(config: JaccardConfig):
    """From sorted blocks of buckets: the rows that have a pair left to verify there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _groups(frames, GROUP):
            left, right = _pairs(config, frame)
            if len(left):
                yield frame.iloc[np.union1d(left, right)]

    return run


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of shingles that the sets of each pair share. Many pairs of few sets are counted by matrix products."""
    at, numbered = np.unique(np.concatenate([left, right]), return_inverse=True)
    n = len(at)
    if len(left) < 32 or 64 * len(left) < n * n:
        out = np.zeros(len(left), np.int64)
        for k, (a, b) in enumerate(zip(left, right, strict=True)):
            a, b = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
            pos = np.searchsorted(b, a)
            out[k] = (b[np.minimum(pos, len(b) - 1)] == a).sum()
        return out
    chosen = [sets[i] for i in at]
    _, columns, counts = np.unique(np.concatenate(chosen), return_inverse=True, return_counts=True)
    shared = counts > 1
    renumber = np.cumsum(shared) - 1
    rows = np.repeat(np.arange(n), [len(s) for s in chosen])[shared[columns]]
    columns = renumber[columns[shared[columns]]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    common, width = np.zeros((n, n), np.float32), max(256, (1 << 22) // n)
    for c in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(columns, [c, c + width])
        hit = np.zeros((n, min(width, int(shared.sum()) - c)), np.float32)
        hit[rows[lo:hi], columns[lo:hi] - c] = 1
        common += hit @ hit.T
    return common[numbered[: len(left)], numbered[len(left) :]].astype(np.int64)


def _verified(config: JaccardConfig):
    """From the rows of _survivors with their texts: links of every text in its group, and one it is linked to."""
    t = Fraction(config.threshold)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for many in _groups(frames, GROUP):
            number = _group_numbers(many, GROUP)
            bounds = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(many)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                frame = many.iloc[lo:hi]
                left, right = _pairs(config, frame)
                sets = [shingles(normalised(x), config.words) for x in frame["text"]]
                sizes = np.array([len(s) for s in sets], np.int64)
                common = _common(sets, left, right)
                linked = common * (t.denominator + t.numerator) >= t.numerator * (sizes[left] + sizes[right])  # |A & B| >= t |A | B|
                left, right = left[linked], right[linked]
                if len(left):
                    key, lab = frame["key"].to_numpy(), _labels(len(frame), left, right)
                    links = np.bincount(left, minlength=len(frame)) + np.bincount(right, minlength=len(frame))
                    has = links > 0
                    yield pd.DataFrame({"key": key[has], "links": links[has], "to": key[lab[has]]})

    return run


def _blocks(rows: DataFrame, per: F.Column) -> DataFrame:
    """Deal the rows of a group to blocks by a hash, and repeat each for every pair of blocks it belongs to."""
    blocks = F.greatest(F.lit(1), F.ceil(per)).cast("int")
    home = F.pmod(F.xxhash64("key", F.lit(7)), F.col("__nb")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("__nb") - 1))
    out = rows.withColumn("__nb", blocks).withColumn("home", home).withColumn("__o", other)
    return out.withColumn("i", F.least("home", "__o")).withColumn("j", F.greatest("home", "__o")).drop("__nb", "__o")


def _row_key() -> dict[str, F.Column]:
    """What tells rows apart: doc_id as text, empty where it is null, and the text's hash."""
    return {"__id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__h": F.xxhash64(F.coalesce("text", F.lit("")))}


def _grouped(together: DataFrame) -> DataFrame:
    return together.repartition(*GROUP).sortWithinPartitions(*GROUP)


def _classified(docs: DataFrame, config: JaccardConfig) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key), and for each key its class: class_id, the row that stays (keep), links and copies."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns(_row_key())
    signed = rows.select("doc_id", "__id", "__h", _signature_of(config)("text").alias("s"))
    signed = stored(signed.select("doc_id", "__id", "__h", "s.*"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__id", "__h")
    copies = F.count_distinct("doc_id") + F.count_if(F.col("doc_id").isNull())
    texts = stored(signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min(row).alias("keep"), copies.alias("copies")))
    unique = stored(signed.where("sig is not null").select("key", "sig", "chars").dropDuplicates(["key"]))

    def band(i: int) -> F.Column:
        at = 1 + 4 * config.rows * i
        return F.struct(F.lit(i).alias("band"), F.xxhash64(F.substring("sig", at, 4 * config.rows)).alias("bucket"))

    banded = unique.select("key", "chars", F.explode(F.array(*[band(i) for i in range(config.bands)])).alias("b")).select("key", "chars", "b.band", "b.bucket")
    full = stored(banded.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("all_chars")).where("n > 1"))
    met = banded.drop("chars").join(full.hint("merge"), ["band", "bucket"])
    dealt = _blocks(met, F.greatest(F.col("n") / config.block, F.col("all_chars") / config.block_chars)).drop("n", "all_chars")
    dealt = _grouped(dealt.join(unique.select("key", "sig").hint("merge"), "key")).select(*GROUP, "home", "key", "sig")
    left = stored(dealt.mapInPandas(_survivors(config), dealt.schema))

    wanted = left.select("key").distinct().join(texts.select("key", "keep.__id", "keep.__h").hint("merge"), "key")
    bodies = rows.select("__id", "__h", "text").join(wanted.hint("merge"), ["__id", "__h"]).dropDuplicates(["__id", "__h"])
    linked = _grouped(left.join(bodies.select("key", "text").hint("merge"), "key"))
    linked = stored(linked.mapInPandas(_verified(config), "key binary, links long, to binary"))
    classes = components(linked.select(F.col("key").alias("a"), F.col("to").alias("b")))
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))

    nodes = stored(classes.withColumnRenamed("node", "key").join(texts.select("key", "doc_id", "keep").hint("merge"), "key"))
    of_class = stored(nodes.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min("keep").alias("class_keep")))
    named = lookup_join(nodes.select("key", "root"), of_class, ["root"], salt="key").drop("root")
    out = texts.join(links.hint("merge"), "key", "left").join(named.hint("merge"), "key", "left")
    first = F.coalesce("class_keep", "keep").alias("keep")
    out = out.select("key", "copies", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), first)
    return signed.select("doc_id", "key"), stored(out)


def similar(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """Class and number of links of every document under n-gram Jaccard similarity.

    docs: doc_id and text. Returns a row for each row of docs: doc_id, class_id (the smallest doc_id of its class), links
    (other different texts at or above the threshold) and copies (documents with the same words in the same order, itself
    included). Classes are the connected components of the links.

    1. Equal word sequences become one text, so copies are never paired. 2. Texts that share a band of MinHash values
    are candidates. A bucket is compared in blocks inside tasks; values are compared a step at a time and a pair is
    dropped when the posterior probability of reaching the threshold falls below the tolerance. What comes out are the
    rows that still have a pair in that bucket, not pairs; a pair counts in the first band that its texts share, so no
    pair is seen twice and a text goes only where it has a pair. 3. These rows get their texts, and the pairs left are
    verified on whole shingle sets (64-bit hashes), and only they; links are summed and linked texts joined into classes.
    Large buckets are dealt to pairs of blocks, all of which are compared: nothing is capped.

    Defined results: null, empty and blank texts are copies of each other and link with nothing; a text of fewer words
    than a shingle is one shingle; an empty table gives an empty table; columns other than doc_id and text aren't read.
    A row without doc_id is a document of its own, and the class_id of a class of such rows only is null. Rows repeated
    with one doc_id and text are one document, and get a row each; a doc_id with several texts has a row for each text.
    """
    rows, classes = _classified(docs, config)
    return rows.join(classes.hint("merge"), "key").select("doc_id", "class_id", "links", "copies")


def one_of_each(docs: DataFrame, config: JaccardConfig = JaccardConfig()) -> DataFrame:
    """Documents without near duplicates, with all columns of docs: one row of each class stays.

    It is that of the smallest doc_id (rows without doc_id come last); of rows repeated with its doc_id and text, one.
    """
    _, classes = _classified(docs, config)
    keep = classes.select("keep.__id", "keep.__h").distinct()
    kept = docs.withColumns(_row_key()).join(keep.hint("merge"), ["__id", "__h"], "left_semi")
    return kept.dropDuplicates(["__id", "__h"]).select(*docs.columns)
