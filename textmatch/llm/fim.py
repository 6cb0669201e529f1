"""Fill-in-middle transformation: lines counted over content-defined chunks whose summaries are memoised."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands before prefix, suffix and middle in an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that the rolling hash sees, and the bounds and the mean length of a chunk.
WINDOW, LEAST, MOST, MEAN = 16, 128, 8_192, 1_024
#: Text that a worker's cache of chunks holds at most, in code points.
CACHE_CHARS = 4 << 20
BASE = 0x01000193


@dataclass(frozen=True)
class Summary:
    """What a chunk adds to its document: its length, where its lines end, whether a marker lies inside, and its edges."""

    chars: int
    ends: np.ndarray  # offsets behind each newline
    marked: bool
    head: str
    tail: str


class ChunkCache:
    """Summaries of chunks seen lately, the least used going first. A chunk is found by its content, so equal hashes of
    different chunks do no harm."""

    def __init__(self, chars: int = CACHE_CHARS):
        self.limit, self.held, self.hits = chars, 0, 0
        self.known: OrderedDict[str, Summary] = OrderedDict()

    def summary(self, chunk: str) -> Summary:
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            self.known.move_to_end(chunk)
            return found
        codes = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = (np.flatnonzero(codes == 10) + 1).astype(np.int32)
        found = Summary(len(chunk), ends, any(m in chunk for m in (PREFIX, SUFFIX, MIDDLE)), chunk[:2], chunk[-2:])
        self.known[chunk] = found
        self.held += len(chunk)
        while self.held > self.limit and len(self.known) > 1:
            old, _ = self.known.popitem(last=False)
            self.held -= len(old)
        return found


def boundaries(text: str, block: int = 1 << 20) -> list[int]:
    """Ends of the chunks of a text: where the rolling hash of the last WINDOW code points is 0 in its middle bits.

    A chunk has LEAST code points or more, but for the last, and MOST at most. Long texts are hashed block by block.
    """
    out, last = [], 0
    for at in range(0, len(text), block):
        codes = np.frombuffer(text[max(0, at - WINDOW + 1) : at + block].encode("utf-32-le", "surrogatepass"), "<u4")
        if len(codes) < WINDOW:
            continue
        rolled, width = codes, 1
        while width < WINDOW:  # hashes of twice the width from two neighbours
            rolled = rolled[:-width] * np.uint32(pow(BASE, width, 1 << 32)) + rolled[width:]
            width *= 2
        mixed = rolled * np.uint32(0x9E3779B1)
        hits = np.flatnonzero((mixed >> np.uint32(12)) % np.uint32(MEAN) == 0) + max(0, at - WINDOW + 1) + WINDOW
        for hit in hits.tolist():
            while hit - last > MOST:
                last += MOST
                out.append(last)
            if hit - last >= LEAST:
                last = hit
                out.append(last)
    while len(text) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(text):
        out.append(len(text))
    return out


def located(text: str, first: int, second: int, cache: ChunkCache) -> tuple[int, bool, int, int]:
    """Number of lines n, whether a marker occurs, and the code points before the two cuts.

    The cuts stand behind the smaller and the larger of first % (n + 1) and second % (n + 1) lines. Counts of chunks are
    added up; the chunk in which the wanted line ends is found in their sums, the place from its summary.
    """
    chars, lines, parts, marked, edge, at = [0], [0], [], False, "", 0
    for end in boundaries(text):
        part = cache.summary(text[at:end])
        parts.append(part)
        marked = marked or part.marked or any(m in edge + part.head for m in (PREFIX, SUFFIX, MIDDLE))
        edge = (edge + part.tail)[-2:] if part.chars < 2 else part.tail
        chars.append(chars[-1] + part.chars)
        lines.append(lines[-1] + len(part.ends))
        at = end
    n = lines[-1] + (len(text) > 0 and text[-1] != "\n")

    def behind(k: int) -> int:
        if k > lines[-1]:
            return len(text)
        if k == 0:
            return 0
        i = int(np.searchsorted(lines, k)) - 1
        return chars[i] + int(parts[i].ends[k - lines[i] - 1])

    a, b = sorted((first % (n + 1), second % (n + 1)))
    return n, marked, behind(a), behind(b)


_CACHE = ChunkCache()


_FOUND = T.StructType([T.StructField(c, T.BooleanType() if c == "marked" else T.LongType()) for c in ("n", "marked", "a", "b")])


@F.pandas_udf(_FOUND)
def _located(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    rows = [located(t, int(x), int(y), _CACHE) for t, x, y in zip(texts, first, second, strict=True)]
    return pd.DataFrame(rows, columns=["n", "marked", "a", "b"])


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Add __n (lines), __form (plain, psm or spm), __prefix_chars, __middle_chars and __output to every row of docs.

    docs: doc_id, text and any other columns. Four numbers drawn from seed and doc_id choose the two cuts, whether the
    text is rearranged (rate in a hundred) and in which order (spm in a hundred with the suffix first). Chunks are
    found by a rolling hash, so that passages shared by documents are cut alike, and a worker counts the lines of a
    shared chunk once. Only numbers come back from Python; the output is put together by Spark. One pass, no shuffle.

    Defined results: a null text is an empty one, which stays plain with no lines; a null doc_id draws from the seed
    alone; a text that holds a marker, also across chunks, stays plain; very long texts are hashed block by block;
    repeated rows get equal results; an empty table gives an empty table; working columns start with two underscores.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    out = docs.withColumns({"__whole": text, **{f"__h{i + 1}": h for i, h in enumerate(drawn)}})
    out = out.withColumn("__at", _located("__whole", "__h1", "__h2"))
    plain = (F.col("__whole") == "") | F.col("__at.marked") | (F.col("__h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("__h4") % 100 < spm, "spm").otherwise("psm")
    whole, a, b = F.col("__whole"), F.col("__at.a").cast("int"), F.col("__at.b").cast("int")
    prefix, middle = F.substring(whole, F.lit(1), a), F.substring(whole, a + 1, b - a)
    suffix = F.substring(whole, b + 1, F.length(whole))
    out = out.withColumn("__form", form)
    rearranged = F.when(F.col("__form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    rearranged = rearranged.when(F.col("__form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut = F.col("__form") != "plain"
    return out.select(
        *docs.columns, F.col("__at.n").alias("__n"), "__form", F.when(cut, F.col("__at.a")).alias("__prefix_chars"),
        F.when(cut, F.col("__at.b") - F.col("__at.a")).alias("__middle_chars"), rearranged.otherwise(whole).alias("__output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its parts hold no marker, so the first of each kind parts them."""
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))

    def between(start: Column, end: Column) -> Column:
        return F.substring(output, start + 3, end - start - 3)

    middle = F.substring(output, m + 3, F.length(output))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
