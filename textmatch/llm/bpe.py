"""Byte-level BPE over whole texts: overlapping chunks, stitched where pre-token boundaries agree."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a chunk, and how far it reads into the next one.
CHUNK, OVERLAP = 16_384, 512


@lru_cache(maxsize=4)
def _coder(path: str, pattern: str):
    """Encoder, the bytes of every id, and the compiled pattern; made once a worker process."""
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table, regex.compile(pattern)


def _ids(coder, text: str):
    return coder.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype("<u4", copy=False)


def _planes(ids: np.ndarray) -> bytes:
    """Ids with their lowest bytes first, then the next ones: the high ones are zeros, which a shuffle compresses well."""
    return ids.view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encoded(docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Token ids of every whole text, and the bytes they decode to.

    docs: doc_id, text; one row out for each row in: doc_id, ids (little-endian unsigned 32-bit integers), decoded
    (binary). vocabulary is the path of a file of ranks that every worker can read. See digests() for the method.
    """
    return _assembled(docs, vocabulary, pattern, chunk, overlap, digest=False)


def digests(docs: DataFrame, vocabulary: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text.

    A text of one chunk is encoded where it is read. A longer one is cut into chunks that read overlap code points
    into the next; chunks are dealt to tasks one by one and pre-tokenised in parallel. Two neighbours are cut apart at
    the first boundary in their overlap that both found, between a visible character and white space: no pre-token
    spans such a place, so it holds whatever stands further left. Pieces between cuts are encoded in parallel and put
    together in order. Where an overlap has no such place (an endless word), the two chunks stay one piece, so the
    result is always that of the whole text.

    Defined results: null and empty texts have no tokens; doc_id comes back as it is, null or of any size; repeated rows
    each get their row; an empty table gives an
    empty table; columns other than doc_id and text are not read. A lone surrogate can't be in a Spark string.
    """
    return _assembled(docs, vocabulary, pattern, chunk, overlap, digest=True)


def _assembled(docs: DataFrame, vocabulary: str, pattern: str, chunk: int, overlap: int, digest: bool) -> DataFrame:
    from textmatch.llm.common import stored

    # doc_id is text in Python: pandas would round numbers that stand beside nulls.
    out = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id string, ids binary, decoded binary"

    def row(ids: list[bytes], decoded: list[bytes]) -> tuple:
        if not digest:
            return b"".join(ids), b"".join(decoded)
        a, b = hashlib.sha256(), hashlib.sha256()
        for x in ids:
            a.update(x)
        for x in decoded:
            b.update(x)
        return sum(map(len, ids)) // 4, a.hexdigest(), b.hexdigest()

    names = [x.split()[0] for x in out.split(", ")]

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, table, _ = _coder(vocabulary, pattern)
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = _ids(coder, text or "")
                rows.append((doc, *row([ids.tobytes()], [b"".join(map(table.__getitem__, ids.tolist()))])))
            yield _frame(rows, names)

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, key, text in zip(frame["doc_id"], frame["key"], frame["text"], strict=True):
                n = -(-len(text) // chunk)
                yield _frame([(doc, key, k, k == n - 1, text[k * chunk : (k + 1) * chunk + overlap]) for k in range(n)], ["doc_id", "key", "k", "last", "text"])

    def boundaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, _, split = _coder(vocabulary, pattern)
        for frame in frames:
            heads, tails = [], []
            for text in frame["text"]:
                at = [m.end() for m in split.finditer(text)]
                sure = [i for i in at if i < len(text) and text[i] in " \t\n\r" and not text[i - 1].isspace()]
                heads.append([i for i in sure if i < overlap])
                tails.append([i - chunk for i in sure if i >= chunk])
            yield frame.assign(head=heads, tail=tails)

    def pieces(frame: pd.DataFrame) -> pd.DataFrame:
        coder, _, _ = _coder(vocabulary, pattern)
        frame = frame.sort_values("k")
        texts, ends = frame["text"].tolist(), frame["cut"].tolist()
        parts = [t[:chunk] for t in texts[:-1]]
        parts.append(texts[-1] if pd.isna(ends[-1]) else texts[-1][: chunk + int(ends[-1])])
        begin = frame["begin"].iloc[0]
        text = "".join(parts)[0 if pd.isna(begin) else int(begin) :]
        first = frame.iloc[0]
        return _frame([(first["doc_id"], first["key"], first["copies"], first["piece"], _planes(_ids(coder, text)))], ["doc_id", "key", "copies", "piece", "ids"])

    def documents(frame: pd.DataFrame) -> pd.DataFrame:
        _, table, _ = _coder(vocabulary, pattern)
        ids = [_from_planes(x) for x in frame.sort_values("piece")["ids"]]
        decoded = [b"".join(map(table.__getitem__, x.tolist())) for x in ids]
        return _frame([(frame["doc_id"].iloc[0], frame["copies"].iloc[0], *row([x.tobytes() for x in ids], decoded))], ["doc_id", "copies", *names[1:]])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk).mapInPandas(whole, out)

    from pyspark.sql import Window

    keyed = rows.where(F.length("text") > chunk).withColumn("key", F.xxhash64("text"))
    cut_up = keyed.mapInPandas(chunks, "doc_id string, key long, k int, last boolean, text string")
    same = ["doc_id", "key", "k"]
    dealt = cut_up.groupBy(*same, "last", "text").agg(F.count(F.lit(1)).alias("copies"))  # repeated rows become one, and a chunk has its own task
    found = stored(dealt.mapInPandas(boundaries, "doc_id string, key long, k int, last boolean, text string, copies long, head array<int>, tail array<int>"))
    # Neighbours compare their lists, without the texts. A window holds the chunks of one document.
    order = Window.partitionBy("doc_id", "key").orderBy("k")
    cuts = found.select(*same, "tail", F.lead("head").over(order).alias("next"))
    cuts = cuts.select(*same, F.array_min(F.array_intersect("tail", "next")).alias("cut"))
    cuts = cuts.withColumn("begin", F.lag("cut").over(order))
    cuts = cuts.withColumn("piece", F.sum(F.col("begin").isNotNull().cast("int")).over(order))
    id_of = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("y")) & (F.col("k") == F.col("kk"))
    placed = found.select(F.col("doc_id").alias("d"), F.col("key").alias("y"), F.col("k").alias("kk"), "text", "copies").join(cuts.hint("merge"), id_of)
    by_piece = placed.select("doc_id", "key", "copies", "k", "text", "cut", "begin", "piece").groupBy("doc_id", "key", "piece")
    coded = by_piece.applyInPandas(pieces, "doc_id string, key long, copies long, piece long, ids binary")
    long = coded.groupBy("doc_id", "key").applyInPandas(documents, f"doc_id string, copies long, {out.split(', ', 1)[1]}")
    long = long.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    every = short.unionByName(long.select(*names))
    return every.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(names)})
