"""Approximate nearest neighbours by a permutation index: pivot orders, inverted files, footrule ranking, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmatch.llm.common import stored


@dataclass(frozen=True)
class IndexConfig:
    """pivots: vectors that others are ordered by, a fixed-size sample (those with the smallest hashes).

    Every vector is posted under its post nearest pivots, and a query reads the lists of its probe nearest. All that it
    meets in its lists is ranked by footrule distance, and reranked by exact score from the nearest on: first the share
    `first` of a block, then `step` more at a time, each time with all that tie with the last, until a step brings
    nothing new among the best. So where pivots can't tell vectors apart, as among near copies, all of them are reranked.
    block bounds the rows of either side that one task compares at once.
    """

    pivots: int = 256
    post: int = 32
    probe: int = 48
    first: float = 0.2
    step: float = 0.05
    block: int = 4096


def valid(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) that can take part: not null or zero, all components finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def _orders(config: IndexConfig, pivots: np.ndarray, top: float):
    """The vector in double precision and its nearest pivots, nearest first: post of a vector's, probe of a query's.

    Largest inner product becomes nearest neighbour by one more component that fills each vector up to the largest
    norm (top); a query gets 0 there. Pivots are filled up likewise.
    """

    def fill(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))

    extra = fill(pivots)

    def order(x: np.ndarray, is_query: bool) -> np.ndarray:
        near = x @ pivots.T
        if not is_query:
            near = near + fill(x)[:, None] * extra
        return np.argsort(-near, axis=1, kind="stable").astype(np.uint16)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["embedding"].to_numpy()).astype(np.float64)
            query = frame["is_query"].to_numpy()
            lists = np.where(query[:, None], order(x, True), order(x, False))
            lists = [row[: config.probe if q else config.post] for row, q in zip(lists, query, strict=True)]
            yield pd.DataFrame({"gid": frame["gid"], "is_query": query, "vector": [v.tobytes() for v in x], "lists": [row.tobytes() for row in lists]})

    return run


def _reranked(order: np.ndarray, distance: np.ndarray, score, exact, names: np.ndarray, k: int, first: int, step: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of candidates that are ordered by footrule distance, their scores, and how many were scored; see
    IndexConfig for where it stops.

    score: of many at once, as a matrix product, right but for rounding (to 1e-12 of its largest); exact: as it is returned.
    """
    best, scores, done, upto = np.empty(0, np.int64), np.empty(0), 0, first
    while done < len(order):
        upto = int(np.searchsorted(distance, distance[min(upto, len(order)) - 1], side="right"))  # with all ties
        new = order[done:upto]
        both, all_scores = np.concatenate([best, new]), np.concatenate([scores, score(new)])
        at = np.arange(len(both))
        if len(both) > k:  # those that rounding may have put below the k-th stay as well
            cut = np.partition(all_scores, -k)[-k]
            at = np.flatnonzero(all_scores >= cut - 1e-12 * (1 + np.abs(all_scores).max()))
        settled = done > 0 and (at < len(best)).all()
        best, scores, done, upto = both[at], all_scores[at], upto, upto + step
        if settled:
            break
    scores = exact(best)
    at = np.lexsort((names[best], -scores))[:k]
    return best[at], scores[at], done


class _Files:
    """Inverted files of one block: for each pivot, the vectors that are posted there, and at which place."""

    def __init__(self, lists: np.ndarray, pivots: int):
        flat = lists.ravel()
        order = np.argsort(flat, kind="stable")
        self.who, self.place = order // lists.shape[1], (order % lists.shape[1]).astype(np.int16)
        self.bounds = np.searchsorted(flat[order], np.arange(pivots + 1))
        self.n = len(lists)

    def nearness(self, names: np.ndarray, longest: int) -> np.ndarray:
        """How far the footrule distance of each vector to a query falls below that of one that shares no pivot, halved.

        Two orders of pivots differ by the sum, over pivots, of how far their places are apart, a pivot that isn't in a
        list having the place behind the longest list's last. A shared pivot at places i and j counts |i - j| instead of
        what is left of both lists, twice (longest - max(i, j)) less. So adding these up over the query's lists ranks by footrule.
        """
        out = np.zeros(self.n, np.int16 if longest * longest < 1 << 15 else np.int32)
        for i, pivot in enumerate(names.tolist()):
            lo, hi = self.bounds[pivot], self.bounds[pivot + 1]
            out[self.who[lo:hi]] += (longest - np.maximum(self.place[lo:hi], i)).astype(out.dtype)
        return out


def _searched(config: IndexConfig, k: int, pivots: int, every: bool):
    """From one block of queries and one of vectors: the k best groups of each query, as (qgid, gid, score), and in met and
    scored how many it met and scored. every: queries meet all vectors."""
    longest = max(config.probe, config.post)

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        names = ["qgid", "gid", "score", "met", "scored"]
        if not len(queries) or not len(vectors):
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in names})
        x = np.frombuffer(b"".join(vectors["vector"]), np.float64).reshape(len(vectors), -1)
        ids = vectors["gid"].to_numpy()
        files = _Files(np.frombuffer(b"".join(vectors["lists"]), np.uint16).reshape(len(x), -1), pivots)
        first, step = max(4 * k, int(config.first * len(x))), max(2 * k, int(config.step * len(x)))
        found = []
        for qid, row, lists in zip(queries["gid"], queries["vector"], queries["lists"], strict=True):
            row = np.frombuffer(row, np.float64)
            near = files.nearness(np.frombuffer(lists, np.uint16), longest)
            order = np.argsort(-near, kind="stable")
            order = order if every else order[: int(np.count_nonzero(near))]
            best, scores, done = _reranked(order, -near[order], lambda new, row=row: x[new] @ row, lambda new, row=row: (x[new] * row).sum(axis=1), ids, k, first, step)
            head = np.arange(len(best)) == 0
            found.append((np.full(len(best), qid), ids[best], scores, head * len(order), head * done))
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

    return run


def _found(queries: DataFrame, vectors: DataFrame, k: int, config: IndexConfig, pivots: int, every: bool) -> DataFrame:
    """What each block of queries finds in each block of vectors. Blocks are dealt by hash, so each has its part of every
    pivot's list, and a crowded list is spread over all of them."""
    nq, nv = (max(1, -(-df.count() // config.block)) for df in (queries, vectors))

    def dealt(df: DataFrame, n: int, others: int, mine: str, theirs: str) -> DataFrame:
        own = F.pmod(F.xxhash64("gid", F.lit(3)), F.lit(n)).cast("int")
        columns = [F.col(c).alias(c) for c in ("gid", "vector", "lists")]  # named anew, as both sides come from one table
        return df.select(own.alias(mine), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(theirs), *columns)

    by = ["qb", "vb"]
    left, right = dealt(queries, nq, nv, "qb", "vb"), dealt(vectors, nv, nq, "vb", "qb")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_searched(config, k, pivots, every), "qgid long, gid long, score double, met long, scored long")


def _best(queries: DataFrame, vectors: DataFrame, k: int, config: IndexConfig, pivots: int, every: bool = False) -> DataFrame:
    """The k best groups of each query over all blocks."""
    found = _found(queries, vectors, k, config, pivots, every)
    by_query = Window.partitionBy("qgid").orderBy(F.desc("score"), "gid")
    return found.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k).drop("n")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, config: IndexConfig = IndexConfig()) -> DataFrame:
    """The k rows of vectors with the largest inner product for each row of queries, its own vec_id left out.

    Both have vec_id and embedding; other columns aren't read. Returns query_id, rank (from 1), vec_id and score, the
    inner product of the original vectors in double precision; equal scores go by smaller vec_id.

    Equal vectors are indexed once, with their k + 1 smallest ids, which are all that can be returned; so a vector that
    a third of all rows share is one posting. The index is approximate in the lists that a query reads and in where its
    reranking stops: measure recall against brute force. A query whose lists hold too few meets every vector.

    Defined results: vectors that are null, zero, or hold a null or non-finite component take no part on either side;
    vectors of one length are searched among themselves, a pass a length, as others have no inner product with them;
    rows repeated with one vec_id count once; with fewer candidates than k, all are returned; empty tables give an
    empty table.
    """
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = stored(valid(vectors)), valid(queries)
    for (dims,) in rows.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect():  # a row a length
        same = F.size("embedding") == dims
        out = out.unionByName(_nearest(rows.where(same), asked.where(same), k, config))
    return out


def _indexed(rows: DataFrame, asked: DataFrame, k: int, config: IndexConfig) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Distinct vectors with their ids, and the posted and the asking ones with their pivots, of vectors of one length."""
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.dense_rank().over(by_vector)).where(F.col("n") <= k + 1)
    unique = stored(few.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("gid", F.element_at("ids", 1)))
    fitted = unique.orderBy(F.xxhash64("embedding"), "gid").select("embedding").limit(config.pivots).collect()  # pivots bounds it
    pivots = np.array([r[0] for r in fitted], np.float64)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    top = float(np.sqrt(unique.agg(F.max(norm)).first()[0]))
    once = asked.groupBy("embedding").agg(F.min("vec_id").alias("gid"))
    both = unique.select("gid", "embedding", F.lit(False).alias("is_query")).unionByName(once.select("gid", "embedding", F.lit(True).alias("is_query")))
    ordered = stored(both.mapInPandas(_orders(config, pivots, top), "gid long, is_query boolean, vector binary, lists binary"))
    return unique, ordered.where("not is_query").drop("is_query"), ordered.where("is_query").drop("is_query"), len(pivots)


def _nearest(rows: DataFrame, asked: DataFrame, k: int, config: IndexConfig) -> DataFrame:
    unique, posted, asking, pivots = _indexed(rows, asked, k, config)
    groups = stored(_best(asking, posted, k + 1, config, pivots).select("qgid", "gid", "score"))
    full = groups.groupBy("qgid").count().where(F.col("count") >= min(k + 1, unique.count()))
    short = stored(asking.join(full.select(F.col("qgid").alias("gid")).hint("merge"), "gid", "left_anti"))
    if short.limit(1).count():  # their lists hold too few: they meet every vector
        kept = groups.join(short.select(F.col("gid").alias("qgid")).hint("merge"), "qgid", "left_anti")
        groups = kept.unionByName(_best(short, posted, k + 1, config, pivots, every=True).select("qgid", "gid", "score"))
    ids = groups.join(unique.select("gid", "ids").hint("merge"), "gid").select("qgid", "score", F.explode("ids").alias("vec_id"))
    best = ids.groupBy("qgid").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("best"))
    once = asked.groupBy("embedding").agg(F.min("vec_id").alias("qgid"))
    named = once.join(best.hint("merge"), "qgid").select("embedding", "best")
    out = asked.select(F.col("vec_id").alias("query_id"), "embedding").distinct().join(named.hint("merge"), "embedding")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def shares(vectors: DataFrame, queries: DataFrame, k: int = 20, config: IndexConfig = IndexConfig()) -> tuple[float, float]:
    """Shares of all distinct vectors that a query meets in its lists, and that it scores, on average; for vectors of one length."""
    unique, posted, asking, pivots = _indexed(valid(vectors), valid(queries), k, config)
    met, scored = _found(asking, posted, k + 1, config, pivots, False).agg(F.sum("met"), F.sum("scored")).first()
    pairs = max(1, unique.count() * asking.count())
    return met / pairs, scored / pairs
