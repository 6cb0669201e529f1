"""The stored index against scores over all pairs."""

import random

from textmatch.operators import inverted as I
from textmatch.operators import retrieval as S


def rows(df):
    return sorted((r["query"], r["rank"], r["phrase"], round(r["score"], 8)) for r in df.collect())


def test_index_equals_scores_of_all_pairs(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    lines = {" ".join(draw.choices(words, weights, k=draw.randint(1, 25))) for _ in range(3000)} | {"", "...", "w0", "w0 w0 w0"}
    asked = [" ".join(draw.choices(words, weights, k=draw.randint(1, 6))) for _ in range(60)] + ["w0 w0", "no such", "", "w299 w0"]
    phrases = spark.createDataFrame([(x,) for x in [*lines, None, "w5"]], "phrase string").repartition(5)
    queries = spark.createDataFrame([(x,) for x in {*asked}], "query string")
    index = I.build_index(phrases)
    assert rows(I.index_topk(queries, index)) == rows(S.bm25_topk(queries, phrases.distinct().fillna("")))
    read, total = I.postings_read(queries, index)
    assert 0 < read < 0.95 * total
    again = I.index_topk(queries.unionByName(queries), index)
    assert rows(again) == rows(I.index_topk(queries, index))


def test_small_and_empty_collections(spark):
    queries = spark.createDataFrame([("a b",), ("c",), (None,)], "query string")
    for many in ([], [("a",)], [("a b",), ("a b c",), ("d",), ("b",), ("e f g",), ("h",)]):
        phrases = spark.createDataFrame(many, "phrase string")
        assert rows(I.index_topk(queries, I.build_index(phrases))) == rows(S.bm25_topk(queries.where("query is not null"), phrases))
