"""Similarity and retrieval: fit scores, lexical candidates, BM25 and semantic matches."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.functions.joins import lookup_join
from textmatch.functions.text import crude_stem, tokens
from textmatch.functions.vectors import cosine, fit_score
from textmatch.sources.storage import stored


@dataclass(frozen=True)
class RetrievalConfig:
    """Okapi parameters are the usual ones of the published package; a negative idf becomes floor times the mean idf."""

    k1: float = 1.5
    b: float = 0.75
    idf_floor: float = 0.25
    top_k: int = 10
    max_pairs: int = 500
    threshold: float = 0.72
    credit: float = 0.65


def score_pairs(postings: DataFrame, profiles: DataFrame, on: list[str]) -> DataFrame:
    """Fit score of every posting with the profile that shares its keys; null where a vector is missing."""
    sides = profiles.select(*on, F.col("vector").alias("__profile"))
    out = postings.join(sides, on, "left")
    return out.withColumn("match_score", fit_score(cosine(F.col("vector"), F.col("__profile")))).drop("__profile")


def rescore(postings: DataFrame, profiles: DataFrame, on: list[str]) -> DataFrame:
    """New score where one can be made, else the old one."""
    fresh = score_pairs(postings.withColumn("__old", F.col("match_score")), profiles, on)
    return fresh.withColumn("match_score", F.coalesce("match_score", "__old")).drop("__old")


def _keys(df: DataFrame, text: str, *kept: str) -> DataFrame:
    """The kept columns, and the distinct tokens and crude stems of a text (__k); its tokens are made once."""
    rows = df.select(*kept, tokens(F.col(text)).alias("__t"))
    return rows.select(*kept, F.array_distinct(F.concat("__t", F.transform("__t", crude_stem))).alias("__k"))


def _gathered(queries: DataFrame, phrases: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A row for each value of by that has both: by.., __q (array of its queries), __lines (its distinct phrases).

    Phrases move once; what is made from the rows stays where they are. Null phrases are left out.
    """
    asked = queries.groupBy(*by).agg(F.collect_list("__q").alias("__q"))
    held = phrases.where("phrase is not null").groupBy(*by).agg(F.collect_set("phrase").alias("__lines"))
    return held.join(asked.hint("shuffle_hash"), list(by))


def lexical_candidates(terms: DataFrame, phrases: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (term, phrase) pairs that share a token or a crude stem.

    by: columns of both sides that a pair must share, such as a document's id; the phrases of each value are a row then,
    and each phrase is held against the terms of its row. Without by it is an equi-join on tokens and stems.
    """
    if not by:
        left, right = (_keys(df, c, c).select(c, F.explode("__k").alias("key")) for df, c in ((terms, "term"), (phrases, "phrase")))
        return left.join(right.hint("shuffle_hash"), "key").select("term", "phrase").distinct()
    asked = _keys(terms.select(*by, "term").distinct(), "term", *by, "term").select(*by, F.struct("term", "__k").alias("__q"))
    lines = _gathered(asked, phrases, by).select(*by, "__q", F.explode_outer("__lines").alias("phrase"))
    met = F.filter("__q", lambda q: F.arrays_overlap(q["__k"], F.col("__k")))
    hits = _keys(lines, "phrase", *by, "__q", "phrase").select(*by, "phrase", F.explode_outer(met).alias("__hit")).where("__hit is not null")
    return hits.select(*by, "__hit.term", "phrase")


def bm25(queries: DataFrame, phrases: DataFrame, config: RetrievalConfig = RetrievalConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """Okapi scores of phrases (phrase) for queries (query) with a shared token. Both sides hold distinct rows.

    by: columns of both sides; the phrases of each of their values are a collection of its own, asked by the queries of
    that value. The token join is the inverted index. Phrases get numbers, and these travel instead of texts. Tokens are
    dealt out once: their counts, document frequencies and the join with the queries stay where they are then.
    """
    by = list(by)
    numbered = stored(phrases.select(*by, "phrase").withColumn("__p", F.monotonically_increasing_id()))
    rows = numbered.select(*by, "__p", tokens(F.col("phrase")).alias("t")).withColumn("dl", F.size("t"))
    words = rows.select(*by, "__p", "dl", F.explode("t").alias("token")).repartition(*by, "token")
    tf = words.groupBy(*by, "token", "__p", "dl").agg(F.count(F.lit(1)).alias("tf")).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy(*by, "token")))
    tf = stored(tf)  # read for the mean and for the hits

    def beside(df: DataFrame, totals: DataFrame) -> DataFrame:
        return df.join(totals.hint("shuffle_hash"), by) if by else df.crossJoin(F.broadcast(totals))  # one row

    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    corpus = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    once = beside(tf.select(*by, "token", "df").distinct(), corpus)
    stats = stored(once.groupBy(*by, "n", "avgdl").agg(F.avg(raw).alias("mean")))
    asked = queries.select(*by, "query", F.explode(tokens(F.col("query"))).alias("token"))
    hits = beside(tf.join(asked.hint("shuffle_hash"), [*by, "token"]), stats)
    idf = F.when(raw < 0, config.idf_floor * F.col("mean")).otherwise(raw)
    part = idf * F.col("tf") * (config.k1 + 1) / (F.col("tf") + config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy(*by, "query", "__p").agg(F.sum(part).alias("score"))
    return scored.join(numbered.select("__p", "phrase").hint("merge"), "__p").drop("__p")


def _best_phrases(lines: list[str], asked: list[str], config: RetrievalConfig) -> Iterator[tuple[str, str, float, int]]:
    """bm25_topk() of one small collection: query, phrase, score, rank."""
    words = [re.findall("[a-z0-9]+", line.lower()) for line in lines]
    distinct, average = [set(w) for w in words], sum(map(len, words)) / len(words)
    df = Counter(t for w in distinct for t in w)
    raw = {f: math.log(len(lines) - f + 0.5) - math.log(f + 0.5) for f in set(df.values())}
    mean = sum(raw[f] * n for f, n in Counter(df.values()).items()) / max(1, len(df))
    wanted = {q: Counter(re.findall("[a-z0-9]+", q.lower())) for q in asked}
    parts: dict[str, dict[int, float]] = {t: {} for tokens_of in wanted.values() for t in tokens_of if t in df}
    for i, w in enumerate(words):
        for t in distinct[i] & parts.keys():
            idf, tf = raw[df[t]], w.count(t)
            idf = config.idf_floor * mean if idf < 0 else idf
            parts[t][i] = idf * tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * len(w) / average))
    for query, copies in Counter(asked).items():
        scores: dict[int, float] = {}
        for t, times in wanted[query].items():
            for i, part in parts.get(t, {}).items():
                scores[i] = scores.get(i, 0.0) + copies * times * part
        best = sorted((-round(x, 9), lines[i]) for i, x in scores.items() if round(x, 9) > 0)[: config.top_k]
        yield from ((query, phrase, -x, rank) for rank, (x, phrase) in enumerate(best, 1))


def _bm25_topk_by(queries: DataFrame, phrases: DataFrame, config: RetrievalConfig, by: tuple[str, ...]) -> DataFrame:
    """bm25_topk() of many collections, each of which is a row; only the best leave its task."""
    rows = _gathered(queries.select(*by, F.col("query").alias("__q")), phrases.select(*by, "phrase"), by)
    result = T.StructType([*[rows.schema[c] for c in by], *T.StructType.fromDDL("query string, phrase string, score double, rank int").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(at, *best) for at, (lines, asked) in enumerate(zip(batch["__lines"], batch["__q"], strict=True)) for best in _best_phrases(list(lines), list(asked), config)]
            best = pd.DataFrame(made, columns=["__at", "query", "phrase", "score", "rank"])
            yield pd.concat([batch[list(by)].iloc[best["__at"].astype(int)].reset_index(drop=True), best.drop(columns="__at")], axis=1)

    return rows.mapInPandas(run, result)


def bm25_topk(queries: DataFrame, phrases: DataFrame, config: RetrievalConfig = RetrievalConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """Best top_k phrases with a positive score for each query; ties by phrase. Scores are rounded to nine places first.

    by: as in bm25(); equal phrases of a collection count once there, and a collection has to fit a row, as the lines of a
    document do. One large collection, without by, is joined by tokens.
    """
    if by:
        return _bm25_topk_by(queries, phrases, config, by)
    scored = bm25(queries, phrases, config).withColumn("score", F.round("score", 9)).where("score > 0")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top_k)


def cap_pairs(candidates: DataFrame, on: str, cap: int = 500) -> DataFrame:
    """With more pairs than cap for a key in total, keep the first floor(n * cap / total), one at least, of each query.

    candidates: on, query, rank. An optional budget of work, stated by the caller; leave it out for all pairs.
    """
    total, n = F.count(F.lit(1)).over(Window.partitionBy(on)), F.count(F.lit(1)).over(Window.partitionBy(on, "query"))
    most = F.greatest(F.lit(1), F.floor(F.col("__n") * cap / F.col("__total")))
    counted = candidates.withColumn("__total", total).withColumn("__n", n)
    return counted.where((F.col("__total") <= cap) | (F.col("rank") <= most)).drop("__total", "__n")


def semantic_match(candidates: DataFrame, vectors: DataFrame, config: RetrievalConfig = RetrievalConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """Best phrase of each query's shortlist by cosine, matched from the threshold on.

    candidates: by.., query, phrase, rank, is_required; stored already, as they are read twice. vectors: text_key (xxhash64
    of a text), vector. Required terms get no credit, others credit times similarity, credit at most. Ties go to the better
    shortlist rank. Only the texts of the best phrases meet their rows again, vectors travel with keys.
    """
    vectors = vectors.where("text_key is not null and vector is not null")
    a, b = vectors.select(F.col("text_key").alias("__a"), F.col("vector").alias("qv")), vectors.select(F.col("text_key").alias("__b"), F.col("vector").alias("pv"))
    asked = stored(candidates.select(F.xxhash64("query").alias("__a")).distinct().join(a.hint("shuffle_hash"), "__a"))
    keyed = candidates.select(*by, F.xxhash64("query").alias("__a"), F.xxhash64("phrase").alias("__b"), "rank")
    scored = lookup_join(keyed.join(b.hint("merge"), "__b"), asked, ["__a"], salt="__b").select(*by, "__a", "rank", F.round(cosine(F.col("qv"), F.col("pv")), 6).alias("sim"))
    best = scored.groupBy(*by, "__a").agg(F.max(F.struct("sim", (-F.col("rank")).alias("r"))).alias("m")).select(*by, "__a", "m.sim", (-F.col("m.r")).alias("rank"))
    named = candidates.withColumn("__a", F.xxhash64("query")).join(best.hint("shuffle_hash"), [*by, "__a", "rank"])
    hit = F.col("sim") >= config.threshold
    credit = F.when(F.col("is_required") | ~hit, F.lit(0.0)).otherwise(F.least(F.lit(config.credit), F.round(config.credit * F.col("sim"), 6)))
    return named.select(*by, "query", "is_required", "phrase", F.col("sim").alias("similarity"), hit.alias("matched"), credit.alias("credit"))


def embedding_calls(candidates: DataFrame) -> DataFrame:
    """Number of distinct strings that need a vector."""
    both = candidates.select(F.col("query").alias("s")).unionByName(candidates.select(F.col("phrase").alias("s")))
    return both.agg(F.countDistinct("s").alias("calls"))


def _nearest(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best vectors of a block for each query of another block, from one matrix product; ties by vec_id, those
    without a score (known is false) last."""

    def stacked(vectors: pd.Series, whole: np.ndarray) -> np.ndarray:
        width = len(vectors[whole].iloc[0]) if whole.any() else 1
        return np.stack([v if fits else np.zeros(width) for v, fits in zip(vectors, whole, strict=True)]).astype(np.float64)

    def nearest(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "known": np.zeros(0, bool)})
        held = held.sort_values("vec_id", kind="stable")
        ids, has, asks = held["vec_id"].to_numpy(), held["whole"].to_numpy(), asked["whole"].to_numpy()
        left, right = stacked(asked["qv"], asks), stacked(held["vector"], has)
        scores = np.round(left @ right.T, 6) if asks.any() and has.any() else np.zeros((len(left), len(right)))
        found = []
        for query, fits, row in zip(asked["query_id"], asks, scores, strict=True):
            at, known = np.flatnonzero(ids != query), has & fits
            order = np.where(known, np.where(np.isnan(row), -np.inf, -row), np.inf)  # as Spark sorts them
            if len(at) > k:
                at = at[order[at] <= np.partition(order[at], k - 1)[k - 1]]  # with ties
            at = at[np.argsort(order[at], kind="stable")][:k]
            found.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "score": row[at], "known": known[at]}))
        return pd.concat(found)

    return nearest


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """Exact k best corpus rows (vec_id, vector) for each query row (query_id, vector) by inner product; ties by vec_id.

    Both sides are dealt to hashed blocks of about `block` rows, and every block of one meets every block of the other in
    one matrix product, from which each query takes its k best, so that no row is made for a pair. The work is the
    product of both sides' rows. A vector that is null or holds a null has no score and comes last.
    """

    def blocks(df: DataFrame) -> int:
        return max(1, -(-df.count() // block))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(df: DataFrame, key: str, n: int, own: str, others: int, other: str) -> DataFrame:
        rows = df.where(F.col(key).isNotNull()).select(key, "vector", F.coalesce(~F.exists("vector", lambda x: x.isNull()), F.lit(False)).alias("whole"))
        return rows.withColumn(own, F.pmod(F.xxhash64(key, "vector"), F.lit(n)).cast("int")).withColumn(other, every(others))

    nq, nv = blocks(queries), blocks(corpus)
    asked, held = dealt(queries, "query_id", nq, "qb", nv, "vb").withColumnRenamed("vector", "qv"), dealt(corpus, "vec_id", nv, "vb", nq, "qb")
    result = T.StructType([queries.schema["query_id"], corpus.schema["vec_id"], *T.StructType.fromDDL("score double, known boolean").fields])
    best = asked.groupBy("qb", "vb").cogroup(held.groupBy("qb", "vb")).applyInPandas(_nearest(k), result)
    best = best.select("query_id", "vec_id", F.when(F.col("known"), F.coalesce("score", F.lit(float("nan")))).alias("score"))  # pandas has nulls for NaN
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_MODELS: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def _loaded(name: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[list[str]], list[list[float]]]:
    """A worker process's own copy of a model."""
    if name not in _MODELS:
        _MODELS[name] = load()
    return _MODELS[name]


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> Callable[[Column], Column]:
    """A column function from a loader of a model: what it returns turns a list of texts into vectors.

    A model is loaded once a worker process, when its first batch comes, and called with `batch` texts at most, each
    distinct text of an Arrow batch once. A null text is an empty one.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("")
        distinct = texts.unique().tolist()
        vectors: dict[str, list[float]] = {}
        for at in range(0, len(distinct), batch):
            part = distinct[at : at + batch]
            vectors.update(zip(part, _loaded(name, load)(part), strict=True))
        return texts.map(vectors.__getitem__)

    return run
