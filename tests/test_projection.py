"""Random projections against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmatch.operators import projection as R
from textmatch.sources import views as V

SCHEMA = "vec_id long, vector array<float>"


def recall(spark, x, asked, k=10, config=R.ProjectionConfig()):
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    queries = corpus.where(F.col("vec_id").isin(asked)).withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in R.projected_topk(queries, corpus, k, config).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = 0
    x = np.asarray(x, np.float32).astype(np.float64)
    for q in asked:
        s = np.round(x @ x[q], 6)
        s[q] = -9
        best = np.lexsort((np.arange(len(x)), -s))[:k]
        mine = sorted(got.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        assert all(m[2] == pytest.approx(s[m[1]], abs=2e-6) for m in mine)
        found += len({m[1] for m in mine} & set(best.tolist()))
    return found / (k * len(asked)), R.met_share(queries, corpus, config)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_given_table(spark, sf):
    rows = V.table(spark, sf.replace("sf0.001", "sf0.1"), "embeddings").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows])
    found, share = recall(spark, x, list(range(0, len(x), 50)))
    assert found >= 0.9 and share < 0.9


def test_clusters_and_growth(spark):
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((60, 32))
    shares = []
    for n in (2_000, 16_000):
        x = unit(np.repeat(centres, n // 60 + 1, axis=0)[:n] + 0.6 * draw.standard_normal((n, 32)))
        found, share = recall(spark, x, list(range(0, n, n // 40)))
        assert found >= 0.9
        shares.append(share)
    assert shares[1] < 0.75 * shares[0]


def test_one_crowded_bucket_and_odd_rows(spark):
    same = [(i, [1.0, 0.0, 0.0]) for i in range(300)]
    odd = [(1000, None), (1001, [1.0, None, 0.0]), (1002, [float("nan"), 0.0, 0.0]), (1003, [1.0]), (1004, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0])]
    corpus = spark.createDataFrame(same + odd, SCHEMA)
    config = R.ProjectionConfig(block=16)
    got = R.projected_topk(corpus.withColumnRenamed("vec_id", "query_id"), corpus, 3, config).collect()
    for q in range(300):
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [v for _, v in mine] == [v for v in range(5) if v != q][:3]
    assert not {r["query_id"] for r in got} & {1000, 1001, 1002, 1003}
    empty = corpus.limit(0)
    assert R.projected_topk(empty.withColumnRenamed("vec_id", "query_id"), corpus).count() == 0
    assert R.projected_topk(corpus.withColumnRenamed("vec_id", "query_id"), empty).count() == 0


def test_probes_go_from_near_to_far():
    normals = R.planes(R.ProjectionConfig(tables=3), 5, 8)
    q = np.random.default_rng(3).standard_normal(8)
    read = R.probes(q, normals, 32)
    assert (read[:, 0] == R.codes(q[None], normals)[0]).all() and all(len(set(row.tolist())) == 32 for row in read)
    margins = normals @ q
    for t, row in enumerate(read):
        own = row[0]
        costs = [sum(margins[t, j] ** 2 for j in range(5) if (c ^ own) >> j & 1) for c in row.tolist()]
        assert costs == sorted(costs)
