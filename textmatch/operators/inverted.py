"""A stored inverted index over one large collection: blocks of phrases with their postings, blocks that can't matter left unread."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmatch.functions.text import tokens
from textmatch.operators.retrieval import RetrievalConfig
from textmatch.sources.storage import stored

#: Phrases of a block, and of a shard, both powers of two; blocks that a query reads first, to know which others can matter.
BLOCK, SHARD, FIRST = 32, 1 << 16, 4
#: Queries that meet a shard at once; cells of the counts by which phrases are put in order.
QUERIES, CELLS = 4096, 1 << 16
BLOCKS = "shard long, phrases array<string>, lengths array<int>, tokens array<string>, sizes array<int>, places array<int>, counts array<int>"


@dataclass(frozen=True)
class Index:
    """blocks: a row a block with its phrases, their lengths in tokens, its distinct tokens, the number of postings of each
    (sizes), and the postings: place of the phrase in the block and count of the token there. weights: token, idf."""

    blocks: DataFrame
    weights: DataFrame
    average: float
    config: RetrievalConfig


def _led(cells: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Phrases with their rarest token (lead), by hashed counts."""

    def rarest(low: str) -> str | None:
        return min(re.findall("[a-z0-9]+", low), key=lambda t: (cells[zlib.crc32(t.encode()) % CELLS], t), default=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(lead=[rarest(low) for low in batch["low"]])

    return run


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of neighbouring phrases of a shard."""
    for batch in batches:
        made = []
        for shard, rows in batch.groupby(batch["pid"] // SHARD, sort=False):
            for at in range(0, len(rows), BLOCK):
                part = rows.iloc[at : at + BLOCK]
                words = [re.findall("[a-z0-9]+", low) for low in part["low"]]
                held: dict[str, list[tuple[int, int]]] = {}
                for place, w in enumerate(words):
                    for token, n in Counter(w).items():
                        held.setdefault(token, []).append((place, n))
                posted = [x for posts in held.values() for x in posts]
                made.append((shard, part["phrase"].tolist(), [len(w) for w in words], list(held), [len(x) for x in held.values()], [x[0] for x in posted], [x[1] for x in posted]))
        yield pd.DataFrame(made, columns=[c.split()[0] for c in BLOCKS.split(", ")])


def build_index(phrases: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> Index:
    """Index of distinct phrases (phrase) as one collection. A null phrase, or one without tokens, counts in the lengths only.

    Phrases are put in order of their rarest token, so that a block is made of phrases that share one and a query finds its
    rare tokens in few blocks. Phrases move twice, to be told apart and to be put in order; postings are made where they are
    then and never move by token, so the list of a word that most phrases hold is spread over all blocks. What is rare
    is told by counts of hashed tokens, CELLS numbers whatever the collection; they decide the order only, no score.
    """
    texts = stored(phrases.select("phrase").distinct())
    rows = texts.select(tokens(F.coalesce("phrase", F.lit(""))).alias("t"))
    n, average = rows.agg(F.count(F.lit(1)), F.avg(F.size("t"))).first()
    df = rows.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    raw = stored(df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    cells = np.zeros(CELLS)
    for cell, often in raw.groupBy((F.crc32("token") % CELLS).cast("int")).agg(F.sum("df")).collect():  # CELLS rows at most
        cells[cell] = often
    low = texts.select("phrase", F.lower(F.coalesce("phrase", F.lit(""))).alias("low"))
    led = low.mapInPandas(_led(cells), "phrase string, low string, lead string")
    dealt = led.repartition("lead", F.pmod(F.xxhash64("phrase"), F.lit(32))).sortWithinPartitions("lead", "phrase")
    blocks = stored(dealt.select(F.monotonically_increasing_id().alias("pid"), "phrase", "low").mapInPandas(_blocks, BLOCKS))
    return Index(blocks, raw.select("token", F.when(F.col("raw") < 0, config.idf_floor * mean).otherwise(F.col("raw")).alias("idf")), average or 1.0, config)


class _Shard:
    """Postings of a shard's blocks for some tokens, in order of token and block; heads are their runs by token and block."""

    def __init__(self, held: pd.DataFrame, wanted: pd.Index, average: float, config: RetrievalConfig) -> None:
        self.phrases = np.array([p for block in held["phrases"] for p in block], dtype=object)
        lengths, counts, places = (np.concatenate([np.asarray(x, dtype=np.int64) for x in held[c]]) for c in ("lengths", "counts", "places"))
        sizes = np.concatenate([np.asarray(x, dtype=np.int64) for x in held["sizes"]])
        start = np.cumsum([0, *map(len, held["phrases"])])[:-1]
        block = np.repeat(np.arange(len(held)), [len(x) for x in held["tokens"]])
        token = wanted.get_indexer(np.concatenate([np.asarray(x, dtype=object) for x in held["tokens"]]))
        keep = np.repeat(token >= 0, sizes)
        self.row = (np.repeat(start[block], sizes) + places)[keep]
        tf = counts[keep].astype(float)
        part = tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * lengths[self.row] / average))
        block, sizes, token = (x[token >= 0] for x in (block, sizes, token))
        first = np.cumsum(sizes) - sizes
        order = np.argsort(token, kind="stable")
        self.part, self.first, self.sizes, self.block = part, first[order], sizes[order], block[order]
        self.most = np.maximum.reduceat(part, first)[order] if len(first) else np.zeros(0)
        self.heads = np.searchsorted(token[order], np.arange(len(wanted) + 1))
        self.blocks = len(held)
        self.rank = np.empty(len(self.phrases), dtype=np.int64)  # of phrases that have postings
        named = np.unique(self.row)
        self.rank[named[np.argsort(self.phrases[named], kind="stable")]] = np.arange(len(named))

    def scores(self, asked: list[tuple[int, float]], chosen: np.ndarray | None) -> tuple[np.ndarray, int]:
        """Sums of weighted parts by phrase over the chosen blocks (all without), and the number of postings read."""
        rows, parts = [np.zeros(0, np.int64)], [np.zeros(0)]
        for token, weight in asked:
            at = slice(self.heads[token], self.heads[token + 1])
            first, sizes = self.first[at], self.sizes[at]
            if chosen is not None:
                first, sizes = first[chosen[self.block[at]]], sizes[chosen[self.block[at]]]
            read = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            rows.append(self.row[read])
            parts.append(self.part[read] * weight)
        rows = np.concatenate(rows)
        return np.bincount(rows, np.concatenate(parts), len(self.phrases)).round(9), len(rows)

    def best(self, asked: list[tuple[int, float]], k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Rows and scores of the k best phrases, ties by phrase; postings read, and all that the tokens have.

        No phrase of a block scores more than the sum of its tokens' largest parts there. The blocks with the largest sums
        are read first; the k-th best score in them is no more than the k-th best of the shard, so blocks that stay
        below it hold none of its best.
        """
        bound, chosen = np.zeros(self.blocks), None
        for token, weight in asked:
            at = slice(self.heads[token], self.heads[token + 1])
            bound[self.block[at]] += max(0.0, weight) * self.most[at]
        total = sum(int(self.sizes[self.heads[t] : self.heads[t + 1]].sum()) for t, _ in asked)
        if self.blocks > FIRST:
            some = np.zeros(self.blocks, dtype=bool)
            some[np.argpartition(-bound, FIRST)[:FIRST]] = True
            first, _ = self.scores(asked, some)
            if (first > 0).sum() >= k:
                chosen = bound >= np.partition(first, len(first) - k)[len(first) - k] - 1e-6
        scores, read = self.scores(asked, chosen)
        at = np.flatnonzero(scores > 0)
        if len(at) > k:
            at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]  # with ties
        at = at[np.lexsort((self.rank[at], -scores[at]))][:k]
        return at, scores[at], read, total


def _asked(queries: DataFrame, index: Index, scan: Callable[[_Shard, list[tuple[int, float]]], pd.DataFrame], result: str) -> tuple[DataFrame, DataFrame]:
    """Distinct queries with a number (qid, query), and what scan makes of each shard and query, with the query's qid.

    Queries are dealt to groups of QUERIES or so, and every group meets every shard in a task.
    """
    numbered = stored(queries.select("query").distinct().where("query is not null").withColumn("qid", F.monotonically_increasing_id()))
    groups = max(1, -(-numbered.count() // QUERIES))
    words = numbered.select("qid", F.explode(tokens(F.col("query"))).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("times"))
    weighed = words.join(index.weights.hint("shuffle_hash"), "token").select("qid", "token", (F.col("times") * F.col("idf")).alias("weight"))
    shards = stored(index.blocks.select("shard").distinct())
    asked = stored(weighed.withColumn("group", F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int"))).join(F.broadcast(shards))  # a row for SHARD phrases
    held = index.blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    average, config = index.average, index.config
    names = ["qid", *(c.split()[0] for c in result.split(", "))]

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame(columns=names)
        wanted = pd.Index(asked["token"].unique())
        shard = _Shard(held, wanted, average, config)
        asked = asked.assign(at=wanted.get_indexer(asked["token"]))
        found = [scan(shard, list(zip(rows["at"], rows["weight"], strict=True))).assign(qid=qid) for qid, rows in asked.groupby("qid")]
        return pd.concat(found)[names]

    keys = ["group", "shard"]
    return numbered, asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, f"qid long, {result}")


def index_topk(queries: DataFrame, index: Index) -> DataFrame:
    """Best top_k phrases with a positive score for each distinct query (query): query, phrase, score, rank. Ties by phrase.

    The rows of bm25_topk() over one collection, from the blocks that can matter. Scores are rounded to nine places first.
    Only the best of a shard leave its task.
    """
    k = index.config.top_k

    def scan(shard: _Shard, asked: list[tuple[int, float]]) -> pd.DataFrame:
        at, scores, _, _ = shard.best(asked, k)
        return pd.DataFrame({"phrase": shard.phrases[at], "score": scores})

    numbered, found = _asked(queries, index, scan, "phrase string, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(numbered.hint("shuffle_hash"), "qid").select("query", "phrase", "score", "rank")


def postings_read(queries: DataFrame, index: Index) -> tuple[int, int]:
    """Postings that index_topk() reads for its scores, and those that all tokens of the queries have."""
    k = index.config.top_k

    def scan(shard: _Shard, asked: list[tuple[int, float]]) -> pd.DataFrame:
        _, _, read, total = shard.best(asked, k)
        return pd.DataFrame({"read": [read], "total": [total]})

    _, counted = _asked(queries, index, scan, "read long, total long")
    read, total = counted.agg(F.sum("read"), F.sum("total")).first()
    return read or 0, total or 0
