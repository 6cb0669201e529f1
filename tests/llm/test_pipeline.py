"""The pipeline's stages over the small tables, against plain Python versions of what each decides."""

import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from textmatch.llm import bpe
from textmatch.llm.common import stored


def test_stages_chain_and_keep_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns, now, seen = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, sf))
        seen[name] = now.collect()
        if name != "tokens":
            assert now.columns == columns
    before = {r["doc_id"] for r in docs.collect()}
    good = {r["doc_id"] for r in seen["quality"]}
    assert len([d for d in before & labels.keys() if labels[d] and d in good]) >= 0.97 * sum(labels.values())
    assert len([d for d in good & labels.keys() if not labels[d]]) <= 0.2 * sum(1 - q for q in labels.values())
    assert {r["doc_id"] for r in seen["near_duplicates"]} <= {r["doc_id"] for r in seen["lines"]} <= good
    texts = [" ".join((r["text"] or "").lower().split()) for r in seen["near_duplicates"]]
    assert len(set(texts)) == len(texts)
    coder, _, _ = bpe._coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = sorted((r["doc_id"], hashlib.sha256(np.array(coder.encode_ordinary(r["text"] or ""), "<u4").tobytes()).hexdigest()) for r in seen["mix"])
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in seen["tokens"]) == want


def test_stages_carry_odd_rows(spark, sf):
    """Rows without id, text, source or language, repeated and very long ones, and columns named like results."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    clean = docs.where("length(text) > 400").limit(1).collect()[0]["text"]
    rows = [(None, clean + " First of two without id.", "en", None, 1), (None, " ".join(reversed(clean.split())), "en", "s", 1), (2**60 + 1, f"{clean} Of a large id.".upper(), "en", "s", 3), (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0)]
    rows += [(10**6 + 2, f"{clean} Said twice.", "en", "s", 3)] * 2 + [(10**6 + 3, " ".join(f"{w} {i}" for i, w in enumerate(clean.split() * 400)), "en", "s", 9)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(*odd.columns).unionByName(odd)
    for c in ("class_id", "keep", "key", "target", "__copies2", "rate", "n"):
        docs = docs.withColumn(c, F.lit("x"))
    now, left = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, sf))
        left[name] = now.collect()
        if name != "tokens":
            assert now.columns == docs.columns and all(r["rate"] == "x" for r in left[name])
    assert len(left["quality"]) == len(left["lines"])
    before, after = ([r for r in left[s] if r["doc_id"] is None] for s in ("lines", "near_duplicates"))
    assert len(before) == 2 and 1 <= len(after) <= 2  # the first may be a near copy of the text it was made from
    assert sorted(str(r["doc_id"]) for r in left["tokens"]) == sorted(str(r["doc_id"]) for r in left["mix"])
    assert sum(r["doc_id"] == 10**6 + 2 for r in left["near_duplicates"]) <= 1


def test_run_of_nothing(spark, tmp_path, sf):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
