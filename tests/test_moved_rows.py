"""What large queries move between tasks, and that their results hold in odd cases."""

import pytest
from pyspark.sql import functions as F

from textmatch.operators import retrieval as S
from textmatch.operators import terms


def exchanges(frame):
    return [line for line in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() + frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def sides(spark):
    queries = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "runner"), (3, "alone")], "doc_id long, query string")
    phrases = spark.createDataFrame([(1, "One."), (1, "One."), (1, "three four"), (1, "two"), (1, None), (2, "running fast"), (2, "runn"), (4, "one")], "doc_id long, phrase string")
    return queries, phrases


def test_f1_candidates_of_a_document_move_no_tokens(spark):
    queries, phrases = sides(spark)
    found = S.lexical_candidates(queries.withColumnRenamed("query", "term"), phrases, ("doc_id",))
    assert sorted(map(tuple, found.collect())) == [(1, "one two", "One."), (1, "one two", "two"), (2, "runner", "runn"), (2, "runner", "running fast")]
    assert not any("key" in line for line in exchanges(found)) and "__lines" not in "".join(exchanges(found.groupBy("doc_id", "term").count()))


def test_f22_best_phrases_of_a_document_move_its_lines_only(spark):
    queries, phrases = sides(spark)
    found = S.bm25_topk(queries, phrases, by=("doc_id",))
    whole = S.bm25_topk(queries.where("doc_id = 1"), phrases.where("doc_id = 1 and phrase is not null").select("phrase").distinct())  # one collection, joined by tokens
    assert sorted((r["query"], r["phrase"], r["rank"], r["score"]) for r in found.where("doc_id = 1").collect()) == sorted((r["query"], r["phrase"], r["rank"], r["score"]) for r in whole.collect())
    assert found.where("doc_id > 1").count() == 0
    assert not any("token" in line for line in exchanges(found))


def test_f12_semantic_matches_move_texts_once(spark):
    rows = [(1, "q", "far", 1, False), (1, "q", "near", 2, False), (1, "q", "also", 3, False), (2, "q", "none", 1, True)]
    candidates = spark.createDataFrame(rows, "doc_id long, query string, phrase string, rank int, is_required boolean")
    vectors = spark.createDataFrame([("q", [1.0, 0.0]), ("far", [0.0, 1.0]), ("near", [1.0, 0.0]), ("also", [2.0, 0.0])], "text string, vector array<double>")
    found = S.semantic_match(candidates, vectors.select(F.xxhash64("text").alias("text_key"), "vector"), by=("doc_id",))
    assert [tuple(r) for r in found.collect()] == [(1, "q", False, "near", 1.0, True, 0.65)]
    assert not any("phrase#" in line and "vector#" in line for line in exchanges(found))


def test_f5_blocks_of_vectors_meet_in_matrix_products(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(90)] + [(90, [float("nan"), 0.0, 0.0]), (91, None)], "vec_id long, vector array<double>")
    asked = vectors.where("vec_id in (0, 50)").select(F.col("vec_id").alias("query_id"), "vector")
    found = S.cosine_topk(asked, vectors, 3, block=20)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()
    rows = [(r["query_id"], r["rank"], r["vec_id"]) for r in found.orderBy("query_id", "rank").collect()]
    best = sorted((i for i in range(90) if i != 50), key=lambda i: (-(i % 7) - 2 * (i % 3), i))
    assert rows == [(0, 1, 90), (0, 2, 1), (0, 3, 2), (50, 1, 90), (50, 2, best[0]), (50, 3, best[1])]


def test_f24_terms_of_other_postings_are_not_looked_for(spark):
    variants = spark.createDataFrame([(1, "a", "big data"), (1, "a", "big-data"), (2, "b", "big data"), (1, "c", "data")], "posting_id long, term string, variant string")
    blocks = spark.createDataFrame([(7, 1, 0, "Big data!", "skills", 2020), (7, 1, 1, "data, big-data", None, None), (8, 2, 0, "big  data", "other", None)], "doc_id long, posting_id long, pos int, text string, section string, recency_year int")
    found = terms.find_terms(variants, blocks, by=("posting_id",))
    assert sorted((r["doc_id"], r["term"], r["matched_variant"], *r["sections_found"], r["last_year"]) for r in found.collect()) == [(7, "a", "big data", "skills", 2020), (7, "c", "data", "skills", 2020), (8, "b", "big data", "other", None)]
    every = terms.find_terms(variants.drop("posting_id"), blocks)
    assert sorted((r["doc_id"], r["term"]) for r in every.collect()) == [(d, t) for d in (7, 8) for t in "abc"]
    # Hits of a document stay where its lines are.
    assert not any("term#" in line for line in exchanges(every))


def test_f3_phrases_of_a_key_are_told_apart_where_its_lines_are(spark):
    lines = spark.createDataFrame([(1, "The quick tests of CI/CD"), (1, "quick tests of a thing"), (2, "alone"), (3, None)], "posting_id long, line string")
    found = terms.extract_phrases(lines, ("the", "of", "a"), spark.createDataFrame([("quick",), ("alone",), ("the",)], "term string"), n=4)
    assert sorted(map(tuple, found.collect())) == sorted([(1, p) for p in ("ci/cd", "quick", "quick tests", "quick tests of ci", "tests of ci", "tests of ci cd", "ci cd", "tests of a thing")] + [(2, "alone")])
    assert not any("phrase#" in line for line in exchanges(found))


def test_f2_shards_of_an_index_send_their_best_only(spark):
    from textmatch.operators import inverted as I

    phrases = spark.createDataFrame([(f"common w{i}",) for i in range(300)], "phrase string")
    queries = spark.createDataFrame([("common",), ("w7 common",)], "query string")
    found = I.index_topk(queries, I.build_index(phrases))
    assert {(r["query"], r["rank"]): r["phrase"] for r in found.collect()}[("w7 common", 1)] == "common w7"
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()
    # A row a posting is neither made nor moved.
    assert not any("block#" in line or "pid#" in line for line in exchanges(found))


def test_f7_terms_by_posting_move_no_words_however_many_postings_there_are(spark, monkeypatch):
    monkeypatch.setattr("textmatch.functions.joins.BROADCAST_ROWS", 1)  # as if the postings were too many to be sent to every task
    spelled = [(1, "a", "big data"), (1, "a", "big-data"), (1, "a", "big data"), (2, "b", "big data"), (1, "c", "data"), (3, "d", "data"), (1, "e", "..."), (None, "f", "data")]
    variants = spark.createDataFrame(spelled, "posting_id long, term string, variant string")
    rows = [(7, 1, 1, "Data, big-data", None, None), (7, 1, 0, "Big data!", "skills", 2020), (7, 1, 2, None, "other", 2024), (8, 2, 0, "big  data", "other", None), (8, 2, 1, "big data", "other", 2011), (9, 4, 0, "data", "other", 2011), (9, None, 0, "data", "other", 2011)]
    found = terms.find_terms(variants, spark.createDataFrame(rows, "doc_id long, posting_id long, pos int, text string, section string, recency_year int"), by=("posting_id",))
    want = [(7, "a", "big data", "skills", 2020), (7, "c", "data", "skills", 2020), (8, "b", "big data", "other", 2011)]
    assert sorted((r["doc_id"], r["term"], r["matched_variant"], *r["sections_found"], r["last_year"]) for r in found.collect()) == want
    assert exchanges(found) and not any("__g#" in line or "__v#" in line for line in exchanges(found))


def test_f10_documents_with_their_blocks_stay_where_they_are(spark):
    spelled = terms.spelled_terms(spark.createDataFrame([(1, "a", "big data"), (1, "a", "bigs"), (1, "c", "data")], "posting_id long, term string, variant string"), ("posting_id",))
    blocks = "array<struct<pos:int,text:string,section:string,recency_year:int>>"
    rows = [(7, 1, [(1, "bigs", "other", 2012)]), (7, 1, [(2, "BIGS", "skills", 2011), (0, "big data", None, None)]), (8, 1, []), (9, 1, None), (9, 2, [(0, "data", "other", 2011)])]
    found = terms.find_spelled(spelled, spark.createDataFrame(rows, f"doc_id long, posting_id long, blocks {blocks}"), ("posting_id",))
    # The rows of one id are told as one document.
    assert sorted((r["doc_id"], r["term"], r["matched_variant"], r["sections_found"], r["last_year"]) for r in found.collect()) == [(7, "a", "big data", ["other", "skills"], 2012), (7, "c", "data", [], None)]
    assert exchanges(found) and all("term#" in line for line in exchanges(found))


def test_f9_facts_of_documents_are_told_where_their_texts_are(spark, sf):
    from textmatch.plans import scoring_queries as P

    assert sorted(map(tuple, P._facts_in_place(spark, sf).collect())) == sorted(map(tuple, P._facts(spark, sf).collect()))
    plan = P._knocked(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "text#" in plan and "SortAggregate" not in plan and "section#" not in plan


def test_f8_documents_meet_a_row_a_posting_not_a_row_a_term(spark, monkeypatch):
    from textmatch.operators import scoring as R

    monkeypatch.setattr("textmatch.functions.joins.BROADCAST_ROWS", 1)
    asked = spark.createDataFrame([(1, "a", 3), (1, "b", 4), (1, "b", 4), (2, "c", 5), (None, "d", 6)], "posting_id long, term string, code int")
    docs = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13), (None, 14)], "posting_id long, doc_id long")
    out = R.asked_terms(docs, asked)
    assert sorted(map(tuple, out.collect())) == [(1, 10, "a", 3), (1, 10, "b", 4), (1, 10, "b", 4), (1, 11, "a", 3), (1, 11, "b", 4), (1, 11, "b", 4), (2, 12, "c", 5)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(__terms") < plan.index("Join Inner")  # terms are rows only behind the join


def test_f8_only_hot_keys_of_a_lookup_are_repeated(spark, monkeypatch):
    from textmatch.functions import joins
    from textmatch.operators import scoring as R

    monkeypatch.setattr("textmatch.functions.joins.BROADCAST_ROWS", 1)
    even = spark.range(2_000).select((F.col("id") % 200).alias("posting_id"), F.col("id").alias("doc_id"))
    mixed = even.unionByName(spark.range(3_000).select(F.when(F.col("id") % 3 > 0, 7).alias("posting_id"), (F.col("id") + 2_000).alias("doc_id")))
    assert joins.hot_keys(even.select("posting_id"), ["posting_id"]).count() == 0
    assert [tuple(r) for r in joins.hot_keys(mixed.select("posting_id"), ["posting_id"]).where("posting_id is not null").collect()] == [(7, 26)]  # of 64 parts
    assert joins.hot_keys(even.where("false"), ["posting_id"]).count() == 0
    asked = spark.range(400).select((F.col("id") % 250).alias("posting_id"), F.concat(F.lit("t"), "id").alias("term"))
    for docs in (even, mixed, even.where("false")):
        out, want = R.asked_terms(docs, asked), docs.join(asked, "posting_id").select("posting_id", "doc_id", "term")
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
        assert "explode([0,1,2" not in out._jdf.queryExecution().optimizedPlan().toString()
    left = joins.lookup_join(mixed, asked, ["posting_id"], "left", salt="doc_id", keys=mixed.select("posting_id"))
    assert sorted(map(str, left.collect())) == sorted(map(str, mixed.join(asked, ["posting_id"], "left").collect()))
    spelled = terms.spelled_terms(asked.withColumn("variant", F.col("term")), ("posting_id",))
    blocks = F.array(F.struct(F.lit(0).alias("pos"), F.concat(F.lit("t"), "posting_id").alias("text"), F.lit("other").alias("section"), F.lit(2020).alias("recency_year")))
    found = terms.find_spelled(spelled, mixed.withColumn("blocks", blocks), ("posting_id",))
    assert sorted((r["doc_id"], r["term"]) for r in found.collect()) == sorted((r["doc_id"], f"t{r['posting_id']}") for r in mixed.where("posting_id is not null").collect())
    assert "explode([0,1,2" not in found._jdf.queryExecution().optimizedPlan().toString()
