"""Term operators without SQL, against plain Python on the smallest documents, and terms and phrases of any length."""

import re

from textmatch import plans
from textmatch.functions import text as X
from textmatch.operators import postings as P
from textmatch.operators import sections as E
from textmatch.operators import terms as T
from textmatch.plans import text_queries as Q
from textmatch.sources import views as V


def protected(text):
    found = [m.group(0) for p in (*X.PROTECTED_ANY_CASE, *X.PROTECTED_BY_CASE) for m in re.finditer(p, text)]
    return {t.lower() for t in found if len(t) >= 4}


def words(text):
    return re.findall("[a-z0-9]+", text.lower())


def lines(spark, sf):
    return [(r["posting_id"], r["line"]) for r in Q._lines(spark, sf).collect()]


def key_phrases(spark, sf):
    allowed, stops = {r["term"] for r in V.terms(spark, sf).collect()}, set(E.COVERAGE_STOP_WORDS)
    out = set()
    for k, line in lines(spark, sf):
        w = words(line)
        found = set(protected(line)) | {x for x in w if x in allowed}
        for n in range(2, 7):
            found |= {" ".join(w[i : i + n]) for i in range(len(w) - n + 1) if w[i] not in stops and w[i + n - 1] not in stops}
        out |= {(k, p) for p in found if len(p) >= 4}
    return out


def test_phrases_and_key_terms(spark, sf):
    want = key_phrases(spark, sf)
    got = plans.queries()["t5_extract_phrases"](spark, sf)
    assert {tuple(r) for r in got.select("posting_id", "phrase").collect()} == want
    covered = set()
    for k, p in want:
        w = p.split(" ")
        covered |= {(k, " ".join(w[i : i + n])) for n in range(1, len(w)) for i in range(len(w) - n + 1)}
    got = plans.queries()["t8_key_terms"](spark, sf)
    assert {tuple(r) for r in got.select("posting_id", "phrase").collect()} == want - covered


def test_chunks_can_be_given(spark):
    rows = spark.createDataFrame([(1, "Uses Next.js daily", ["daily use", "a chunk of far more than six words"])], "posting_id int, line string, said array<string>")
    got = T.extract_phrases(rows, (), spark.createDataFrame([("daily",)], "term string"), chunks="said").collect()
    assert {r["phrase"] for r in got} == {"next.js", "daily use", "daily"}


def test_tech_terms_protected_tokens_and_whitelists(spark, sf):
    patterns = [re.compile(rf"(?i)(?<![A-Za-z0-9_])(?:{g})(?![A-Za-z0-9_])") for g in T.TECH_GROUPS]

    def tech(text):
        return sorted({m.group(0) for p in patterns for m in p.finditer(text)})

    texts = {r["posting_id"]: r["description"] for r in Q.spliced(spark, sf).collect()}
    assert {r["posting_id"]: r["terms"] for r in plans.queries()["t1_tech_terms"](spark, sf).collect()} == {k: "|".join(tech(t)) for k, t in texts.items()}
    segments = {r["c_custkey"]: r["c_mktsegment"] for r in V.table(spark, sf, "customer").collect()}
    tail = "uses Next.js, CI/CD, LangChain, Weights & Biases and full-stack Python 3.11"
    assert {r["c_custkey"]: r["tokens"] for r in plans.queries()["t4_protected_tokens"](spark, sf).collect()} == {k: "|".join(sorted(protected(f"{s} {tail}"))) for k, s in segments.items()}
    want = {}
    for r in V.versions(spark, sf).where("is_current").collect():
        text = " ".join([x for x in (r["content"],) if x is not None] + ["Python, C++ and Docker" if r["version_id"] % 3 == 0 else "React/Go"])
        want.setdefault(r["profile_id"], set()).update(tech(text))
    assert {r["profile_id"]: r["skills"] for r in plans.queries()["t3_skill_whitelist"](spark, sf).collect()} == {k: "|".join(sorted(v)) for k, v in want.items()}


def test_subphrases_of_any_length_go(spark):
    long = "one two three four five six seven eight"
    rows = spark.createDataFrame([(1, long), (1, "two three four five six seven eight"), (1, "six"), (2, "six")], "posting_id int, phrase string")
    assert sorted(map(tuple, T.dedup_subphrases(rows).collect())) == [(1, long), (2, "six")]


def test_technical_words_need_no_second_occurrence(spark):
    rows = spark.createDataFrame([(1, "PostgreSQL once"), (1, "twice here"), (1, "twice there")], "posting_id int, line string")
    assert {r["phrase"]: r["n"] for r in T.ngram_phrases(rows, 2).collect()} == {"postgresql": 1, "postgresql once": 1, "twice": 2}


def test_terms_inside_words(spark):
    texts = spark.createDataFrame([(1, "Foobar C++17"), (2, "bar"), (3, None), (4, "")], "doc_id int, text string")
    terms = spark.createDataFrame([("bar",), ("OBAR",), ("c++",), ("foobars",), ("",)], "term string")
    assert sorted(map(tuple, T.contained_terms(texts, terms).collect())) == [(1, "OBAR"), (1, "bar"), (1, "c++"), (2, "bar")]


def test_any_number_of_profiles_is_paired(spark):
    pairs = P.pair_postings_profiles(spark.range(3).withColumnRenamed("id", "posting_id"), spark.range(1001).withColumnRenamed("id", "profile_id"), block=100)
    assert pairs.distinct().count() == pairs.count() == 3 * 1001


def test_phrases_of_sixteen_words(spark):
    from textmatch.operators import terms as T

    words = " ".join(f"w{i}" for i in range(20))
    lines = spark.createDataFrame([(1, words), (1, words + " more")], "posting_id long, line string")
    got = {r["phrase"]: r["n"] for r in T.ngram_phrases(lines, n=16).collect()}
    assert got[" ".join(f"w{i}" for i in range(16))] == 2 and "" not in got
    assert sorted(got) == sorted(" ".join(f"w{i}" for i in range(a, a + n)) for n in range(1, 17) for a in range(21 - n))
    for n in (0, 1024):
        try:
            T.ngram_phrases(lines, n=n)
        except ValueError:
            continue
        raise AssertionError(n)
