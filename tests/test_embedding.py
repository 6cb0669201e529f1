"""The seeded projection, and how often a model is loaded and called."""

import numpy as np
import pytest

from textmatch.functions.embedding import features, hash_projection
from textmatch.operators import retrieval as S


def test_features_and_vectors():
    assert features("Go 42!") == ["go", "42", "_go", "go_", "_42", "42_"]
    embed = hash_projection()
    a, b, c, none = np.array(embed(["data engineer at scale", "engineers of data", "quiet morning walk", "..."]))
    assert np.linalg.norm(a) == pytest.approx(1) and not none.any()
    assert a @ b > 0.4 > abs(a @ c)
    assert (np.array(hash_projection()(["data engineer at scale"])[0]) == a).all()
    assert (np.array(hash_projection(seed="q")(["data engineer at scale"])[0]) != a).any()
    with pytest.raises(ValueError):
        hash_projection(spread=9)


def test_a_model_is_loaded_once_a_worker_and_called_by_batches(spark, tmp_path):
    log = str(tmp_path / "log")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"load {os.getpid()}\n")

        def embed(texts):
            with open(log, "a") as f:
                f.write(f"call {len(texts)} {len(set(texts))}\n")
            return [[float(len(t))] for t in texts]

        return embed

    texts = [f"t{i % 50}" for i in range(400)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    run = S.embedder(load, batch=20)
    for _ in range(2):
        got = rows.select("text", run("text").alias("v")).collect()
        assert [r["v"] for r in got] == [[float(len(t or ""))] for t in texts]
    lines = open(log).read().split("\n")[:-1]
    loads, calls = [x for x in lines if x.startswith("load")], [x.split() for x in lines if x.startswith("call")]
    assert len(loads) == len(set(loads))
    assert all(int(n) <= 20 and n == m for _, n, m in calls)
    assert rows.where("false").select(run("text").alias("v")).count() == 0
