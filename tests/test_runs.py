"""Phrases told apart where the lines of their key are."""

import random

from textmatch.operators import terms as T


def exchanges(frame):
    return [line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_f4_key_terms_are_phrases_without_their_parts(spark):
    draw = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "CI/CD", "PostgreSQL", "Weights & Biases", "python 3", "python 3.11", "end to end", "ABCD", "x", "Next.js", "full stack"]
    rows = [(i % 40 if i % 9 else None, " ".join(draw.choices(words, k=draw.randint(1, 9))), draw.choices([["daily use"], ["alpha beta", "beta"], None, ["a b c d e f g"]])[0]) for i in range(400)]
    lines = spark.createDataFrame([*rows, (1, None, None), (2, "", None), (77, "the", None), (78, "of alpha of", None)], "posting_id long, line string, said array<string>")
    allowed = spark.createDataFrame([(w,) for w in ("alpha", "the", "beta", "gamma", "postgresql", "biases", "python")], "term string")
    for n, chunks in ((6, None), (3, None), (2, None), (6, "said")):
        found = T.key_terms(lines, ("the", "of", "to"), allowed, n, chunks=chunks)
        plain = T.dedup_subphrases(T.extract_phrases(lines.where("posting_id is not null"), ("the", "of", "to"), allowed, n, chunks=chunks))
        rows = [tuple(r) for r in found.where("posting_id is not null").collect()]
        assert len(rows) == len({*rows}) and {*rows} == {tuple(r) for r in plain.collect()}
        assert not any("phrase#" in line for line in exchanges(found))


def test_f13_f14_phrases_are_counted_where_the_lines_are(spark):
    lines = spark.createDataFrame([(1, "Big data of PostgreSQL"), (1, "big data"), (None, "null key null key"), (2, None)], "posting_id long, line string")
    found = T.ngram_phrases(lines, 2)
    assert sorted((str(r["posting_id"]), r["phrase"], r["n"]) for r in found.collect()) == sorted([("1", "big", 2), ("1", "data", 2), ("1", "big data", 2), ("1", "postgresql", 1), ("1", "of postgresql", 1), ("None", "null", 2), ("None", "key", 2), ("None", "null key", 2)])
    assert not any("__h" in line or "at#" in line for line in exchanges(found))
    rows = spark.createDataFrame([(1, "a b c", 7), (1, "b c", 8), (1, "c", 9), (2, "c", 1), (None, "a b", 2), (None, "a", 3), (1, None, 4)], "posting_id long, phrase string, n long")
    kept = T.dedup_subphrases(rows)
    assert sorted(r["n"] for r in kept.collect()) == [1, 2, 3, 4, 7]
    assert not any("phrase#" in line for line in exchanges(kept))
    large = spark.createDataFrame([((1 << 60) + 1, "twice twice"), (None, "twice twice")], "posting_id long, line string")
    assert {r["posting_id"] for r in T.ngram_phrases(large, 1).collect()} == {(1 << 60) + 1, None}


def test_f15_f16_f19_terms_are_counted_in_their_text_without_copies_of_it(spark):
    texts = spark.createDataFrame([(1, "AAaa a.b A.B xa.b a.ba C++ c++17", "a.b"), (2, None, None), (3, "", "")], "posting_id long, description string, title string")
    terms = spark.createDataFrame([(k, t) for k in (1, 2, 3) for t in ("aa", "a.B", "c++", "none", "")], "posting_id long, term string")
    alone = T.term_frequency(terms.where("term <> ''"), texts, ["posting_id"])
    assert {r["term"]: r["freq"] for r in alone.where("posting_id = 1").collect()} == {"aa": 0, "a.B": 2, "c++": 1, "none": 0}
    assert alone.where("posting_id > 1 and freq > 0").count() == 0 and alone.count() == 12
    assert [r["term"] for r in T.present_terms(terms, texts, ["posting_id"]).orderBy("term").collect()] == ["a.B", "c++"]
    weights = T.weighted_terms(terms.withColumn("section", T.F.lit("other")), texts)
    assert {r["term"]: r["freq"] for r in weights.where("posting_id = 1").collect()} == {"aa": 2, "a.B": 4, "c++": 2, "none": 0, "": 0}
    assert "ArrowEvalPython" in weights._jdf.queryExecution().optimizedPlan().toString()


def test_f17_texts_are_not_moved_to_look_for_terms_inside(spark):
    texts = spark.createDataFrame([(1, "Foobar C++17\nbig  data"), (2, "bar\nBIG DATA, and big\tdata"), (3, None), (4, ""), (5, "a\nb bar bar"), (5, "bar")], "doc_id int, text string")
    terms = spark.createDataFrame([(t,) for t in ("bar", "OBAR", "c++", "foobars", "", "big data", "big\tdata", "a\nb", "b b", "a")], "term string")
    found = T.contained_terms(texts, terms)
    assert sorted(map(tuple, found.collect())) == sorted([(1, "OBAR"), (1, "a"), (1, "bar"), (1, "c++"), (2, "a"), (2, "bar"), (2, "big data"), (2, "big\tdata"), (5, "a"), (5, "b b"), (5, "bar")])
    assert all("posting_id" not in line and "term#" in line for line in exchanges(found))
