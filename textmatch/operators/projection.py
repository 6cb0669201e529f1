"""Nearest vectors between two large tables: signed random projections, several buckets probed, exact scores of what is met."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmatch.sources.storage import stored


@dataclass(frozen=True)
class ProjectionConfig:
    """tables: independent sets of planes. A code has so many bits that a bucket holds about per_bucket vectors.

    A query reads the 2 ** (reach * bits) buckets of each table whose codes differ from its own in the planes that it is
    nearest to. So the share of all vectors that it meets falls as their number grows, to the power reach - 1. regions is
    a power of two: vectors are dealt to tasks by table and the first bits of their codes, and to blocks of at most
    about `block` rows of either side, so one crowded bucket is shared out.
    """

    tables: int = 8
    per_bucket: int = 4
    reach: float = 0.63
    most_bits: int = 16
    regions: int = 16
    block: int = 4096
    seed: int = 7


def bits_of(n: int, config: ProjectionConfig) -> int:
    least = config.regions.bit_length() - 1
    return min(config.most_bits, max(least, round(np.log2(max(1, n) / config.per_bucket))))


def planes(config: ProjectionConfig, bits: int, dims: int) -> np.ndarray:
    """Normals of the planes: tables x bits x dims, from the seed alone."""
    return np.random.default_rng(config.seed).standard_normal((config.tables, bits, dims))


def codes(x: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Code of each vector in each table: a bit for every plane that it lies in front of."""
    sides = np.einsum("nd,tbd->ntb", x, normals) > 0
    return sides @ (1 << np.arange(normals.shape[1]))


def probes(q: np.ndarray, normals: np.ndarray, count: int) -> np.ndarray:
    """Codes of the buckets that a query reads in each table: those with the least sum of squared distances to the planes
    on whose other side they are, its own first."""
    margins = normals @ q
    own = (margins > 0) @ (1 << np.arange(margins.shape[1]))
    costs, masks = np.zeros((len(margins), 1)), np.zeros(1, np.int64)
    for j in range(margins.shape[1]):
        costs = np.concatenate([costs, costs + margins[:, j : j + 1] ** 2], axis=1)
        masks = np.concatenate([masks, masks | 1 << j])
    return own[:, None] ^ masks[np.argsort(costs, axis=1, kind="stable")[:, :count]]


def _usable(df: DataFrame, name: str) -> DataFrame:
    whole = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.col(name).isNotNull() & whole).select(name, "vector")


def _placed(rows: DataFrame, name: str, table: np.ndarray, config: ProjectionConfig, count: int | None) -> DataFrame:
    """A row for each region that a vector lies in, or, with count, that a query reads: with the codes it has there."""
    bits = table.shape[1]
    shift = bits - (config.regions.bit_length() - 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                x = np.stack(part["vector"].to_numpy()).astype(np.float64)
                wanted = codes(x, table)[:, :, None] if count is None else np.stack([probes(q, table, count) for q in x])
                out = []
                for key, vector, by_table in zip(part[name], x, wanted, strict=True):
                    data = vector.tobytes()
                    for t, many in enumerate(by_table):
                        where = many >> shift
                        for region in np.unique(where):
                            out.append((key, data, t * config.regions + int(region), many[where == region].astype(np.int32).tobytes()))
                yield pd.DataFrame(out, columns=["key", "vector", "region", "codes"])

    return rows.mapInPandas(run, "key long, vector binary, region int, codes binary")


def _met(k: int):
    """From the rows of one block pair: the k best vectors of each query among those whose codes it reads, and how many it met."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "met": pd.Series(dtype="int64")})
        if not len(queries) or not len(vectors):
            return empty
        held = np.frombuffer(b"".join(vectors["codes"]), np.int32)
        order = np.argsort(held, kind="stable")
        held, ids = held[order], vectors["key"].to_numpy()[order]
        x = np.frombuffer(b"".join(vectors["vector"]), np.float64).reshape(len(vectors), -1)[order]
        out = []
        for query, vector, read in zip(queries["key"], queries["vector"], queries["codes"], strict=True):
            read = np.frombuffer(read, np.int32)
            lo, hi = np.searchsorted(held, read, "left"), np.searchsorted(held, read, "right")
            some = hi > lo
            if not some.any():
                continue
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo[some], hi[some], strict=True)])
            at = at[ids[at] != query]
            if not len(at):
                continue
            scores = np.round(x[at] @ np.frombuffer(vector, np.float64), 6)
            best = np.lexsort((ids[at], -scores))[:k]
            out.append((np.full(len(best), query), ids[at][best], scores[best], np.where(np.arange(len(best)) == 0, len(at), 0)))
        if not out:
            return empty
        return pd.DataFrame(dict(zip(empty.columns, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def _pairs(queries: DataFrame, corpus: DataFrame, k: int, config: ProjectionConfig) -> DataFrame:
    held = stored(_usable(corpus, "vec_id").withColumn("dims", F.size("vector")))
    usual = held.groupBy("dims").count().orderBy(F.desc("count"), "dims").first()
    dims, n = (usual["dims"], usual["count"]) if usual else (1, 0)
    bits = bits_of(n, config)
    normals, count = planes(config, bits, dims), max(1, round(2 ** (config.reach * bits)))
    vectors = stored(_placed(held.where(F.col("dims") == dims).select("vec_id", "vector"), "vec_id", normals, config, None))
    asked = stored(_placed(_usable(queries, "query_id").where(F.size("vector") == dims), "query_id", normals, config, count))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / config.block).cast("int").alias(name))

    sizes = stored(blocks(asked, "qn").join(blocks(vectors, "vn").hint("merge"), "region"))  # tables * regions rows at most
    own = F.pmod(F.xxhash64("key"), F.col("n")).cast("int")

    def dealt(df: DataFrame, n: str, other: str, mine: str, theirs: str) -> DataFrame:
        placed = df.join(F.broadcast(sizes), "region").withColumn("n", F.col(n)).withColumn(mine, own)
        return placed.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("region", "qb", "vb", "key", "vector", "codes")

    by = ["region", "qb", "vb"]
    left, right = dealt(asked, "qn", "vn", "qb", "vb"), dealt(vectors, "vn", "qn", "vb", "qb")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_met(k), "query_id long, vec_id long, score double, met long")


def projected_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, config: ProjectionConfig = ProjectionConfig()) -> DataFrame:
    """About the k best corpus rows (vec_id, vector) for each query row (query_id, vector), both sides of any size.

    The form of cosine_topk() for two large tables. Vectors are of unit length, or near it, so the largest inner product
    is the smallest angle, which is what sides of random planes tell of. Scores are exact and to six places; ties go by
    vec_id. A query can miss vectors whose buckets it doesn't read: see met_share() and the tests for how many.

    Vectors that are null or hold a null or no finite number, and those of another length than most of the corpus, take
    no part; equal ids on both sides are the same vector and aren't paired; rows with one id count once.
    """
    once = _pairs(queries, corpus, k, config).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def met_share(queries: DataFrame, corpus: DataFrame, config: ProjectionConfig = ProjectionConfig()) -> float:
    """Scores made for a query over vectors there are; a vector met in two tables is scored twice."""
    met = _pairs(queries, corpus, 1, config).agg(F.sum("met")).first()[0] or 0
    return met / max(1, queries.count() * corpus.count())
