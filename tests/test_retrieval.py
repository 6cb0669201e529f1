"""Exact retrieval against plain Python."""

import random

from textmatch.operators import retrieval as S


def test_cosine_topk_over_many_blocks(spark):
    draw = random.Random(5)
    rows = [(i, [float(draw.randint(-3, 3)) for _ in range(4)]) for i in range(120)]  # many equal scores
    corpus = spark.createDataFrame([*rows, (200, None)], "vec_id long, vector array<float>")
    asked = spark.createDataFrame(rows[::3], "query_id long, vector array<float>")
    got = sorted(map(tuple, S.cosine_topk(asked, corpus, 5, block=16).select("query_id", "rank", "vec_id", "score").collect()))
    want = []
    for q, x in rows[::3]:
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), v) for v, y in rows if v != q)[:5]
        want += [(q, n, v, -s) for n, (s, v) in enumerate(scored, 1)]
    assert got == want
    few = S.cosine_topk(asked, corpus.where("vec_id in (0, 200)"), 5).where("query_id = 3").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"] is None) for r in few] == [(0, False), (200, True)]
    assert S.cosine_topk(asked, corpus.limit(0)).count() == 0


def test_cosine_topk_has_no_limit_of_queries(spark):
    asked = spark.range(10_500).selectExpr("id + 100 AS query_id", "array(float(id), 1.0f) AS vector")
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, vector array<float>")
    assert S.cosine_topk(asked, corpus, 2).count() == 21_000
