"""Rule tables: literal expectations for each ladder of conditions, worked out by hand."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textmatch.functions import text as X
from textmatch.functions.vectors import fit_score
from textmatch.operators import compare as C
from textmatch.operators import edits as V
from textmatch.operators import experience as Y
from textmatch.operators import scoring as R
from textmatch.operators import sections as E
from textmatch.operators import terms as T

SOME = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(list(enumerate(rows)) if not isinstance(rows[0], tuple) else [(i, *r) for i, r in enumerate(rows)], f"id int, {schema}").orderBy("id").select(column).collect()]


def test_fit_score(spark):
    assert values(spark, "x double", [0.15, 0.425, 0.70, 0.05, 0.9, None], fit_score(F.col("x"))) == [0, 50, 100, 0, 100, None]


def test_recency(spark):
    assert values(spark, "y int", [2025, 2021, 2017, 2030, None], R.recency_score(F.col("y"))) == [1.0, 0.75, 0.5, 1.0, 0.5]


def score(spark, rows, knocked=None):
    schema = "posting_id int, doc_id int, is_required boolean, matched boolean, placement double, recency double"
    return R.aggregate_score(spark.createDataFrame([(1, 1, *r) for r in rows], schema), knocked).first()


WORKED = [
    (True, True, 1.5, 1.0), (True, True, 1.0, 0.75), (True, True, 1.0, 0.5), (True, False, None, None), (False, True, 0.6, 0.5), (False, False, None, None),
]


def test_aggregate_score(spark):
    got = score(spark, WORKED)
    assert (got["required_score"], got["preferred_score"], got["placement_score"], got["recency_score"], got["ats_score"]) == (75.0, 50.0, 5.7, 6.0, 65.4)
    out = score(spark, WORKED, spark.createDataFrame([(1, 1, False)], "posting_id int, doc_id int, passes boolean"))
    assert (out["ats_score"], out["required_score"], out["passes"]) == (0.0, 0.0, False)
    none = score(spark, [(True, False, None, None)])
    assert none["preferred_score"] == 100.0


@SOME
@given(st.lists(st.tuples(st.booleans(), st.booleans(), st.sampled_from([0.6, 0.8, 1.0, 1.5]), st.sampled_from([0.5, 0.75, 1.0])), min_size=1, max_size=8))
def test_score_is_bounded(spark, rows):
    got = score(spark, [(r, m, p if m else None, c if m else None) for r, m, p, c in rows])
    assert 0 <= got["ats_score"] <= 100


def test_labels(spark):
    band = C.pass_band(F.col("s"), F.col("p"))
    assert values(spark, "s double, p boolean", [(85.0, True), (84.9, True), (70.0, True), (50.0, True), (49.9, True), (100.0, False)], band) == ["strong_pass", "likely_surfaced", "likely_surfaced", "borderline", "likely_filtered", "likely_filtered"]
    impact = C.impact_level(F.col("r"), F.col("f"))
    assert values(spark, "r boolean, f int", [(True, 2), (True, 1), (False, 2), (False, 1), (True, 0)], impact) == ["high", "medium", "medium", "low", "medium"]
    years = C.yoe_status_label(F.col("q"), F.col("y"))
    assert values(spark, "q int, y int", [(None, 3), (5, 4), (10, 7), (10, 6)], years) == ["not_required", "satisfied", "partial", "not_satisfied"]
    assert values(spark, "x double", [0.04, 1.25, -2.0], C.delta_label(F.col("x"))) == ["no change", "+1.2", "-2.0"]


def test_weights(spark):
    found = spark.createDataFrame([(1, "api", "required"), (1, "api", "other"), (1, "go", "other"), (1, "sql", "preferred")], "posting_id int, term string, section string")
    texts = spark.createDataFrame([(1, "api api api api go go " + "sql " * 9, "Senior API lead")], "posting_id int, description string, title string")
    got = {r["term"]: r["weight"] for r in T.weighted_terms(found, texts).collect()}
    assert got == {"api": 9.0, "go": 1.0, "sql": 3.9}


def test_coverage(spark):
    schema = "p int, weight double, exact boolean, credit double"
    assert T.coverage(spark.createDataFrame([(1, 2.0, True, 0.0), (1, 2.0, False, 0.5)], schema), ["p"]).first()["coverage"] == 75.0
    assert T.coverage(spark.createDataFrame([(1, 0.0, False, 0.0)], schema), ["p"]).first()["coverage"] == 100.0


def test_variants(spark):
    short = spark.createDataFrame([("ml", "machine learning"), ("api", "application programming interface")], "term string, expansion string")
    got = {}
    for r in T.term_variants(spark.createDataFrame([("machine learning",), ("api",), ("CI/CD",)], "term string"), short).collect():
        got.setdefault(r["term"], set()).add(r["variant"])
    assert {"machine learning", "machine-learning", "ml", "machine learne", "machine-learned"} <= got["machine learning"]
    assert {"api", "apis", "application programming interface"} <= got["api"] and {"ci/cd", "ci cd", "ci-cd"} <= got["CI/CD"]


@SOME
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=4).map(" ".join), min_size=1, max_size=8, unique=True))
def test_no_kept_phrase_is_part_of_another(spark, phrases):
    kept = [r["phrase"] for r in T.dedup_subphrases(spark.createDataFrame([(1, p) for p in phrases], "posting_id int, phrase string")).collect()]
    assert sorted(kept) == sorted(p for p in phrases if not any(q != p and f" {p} " in f" {q} " for q in phrases))


def test_years_and_degrees(spark):
    posts = spark.createDataFrame([(1, "5+ years of experience in a similar role; 3 to 4 yrs with big data tools\n5 years in a similar role. 0 years")], "posting_id int, text string")
    got = [(r["years"], r["context"], r["is_generic"]) for r in Y.yoe_requirements(posts).orderBy("pos").collect()]
    assert got == [(5, "a similar role", True), (3, "big data tools", False)]
    docs = spark.createDataFrame([(1, "4 years of experience in big data", 5), (2, "", 4), (3, "", 3)], "doc_id int, text string, span int")
    reqs = spark.createDataFrame([(1, d, 0, 5, "", True) for d in (1, 2, 3)], "posting_id int, doc_id int, pos int, years int, context string, is_generic boolean")
    status = {r["doc_id"]: r["status"] for r in Y.yoe_status(reqs, Y.yoe_claims(docs), docs).collect()}
    assert status == {1: "satisfied", 2: "partial", 3: "unsatisfied"}
    assert values(spark, "t string", ["must be kind", "B.E. in physics", "PhD or MSc", ""], Y.degree_level(F.col("t"), True, 0)) == [0, 3, 5, 0]


def test_edit_rules_in_order(spark):
    blocks = spark.createDataFrame([(1, "b1", "bullet", "Built fast data services for banks"), (1, "h", "h1", "Experience")], "doc_id int, block_id string, block_type string, text string")
    base = "Built fast data services for banks"
    texts = [("x", base), ("b1", " "), ("b1", base + " <b>x</b> zig"), ("b1", base + " *x*"), ("h", "New heading"), ("b1", base + " with zig"), ("b1", "python"), ("b1", base + " with Python")]
    edits = spark.createDataFrame([(1, b, t, ["python", "heading", "new"], i) for i, (b, t) in enumerate(texts)], "doc_id int, block_id string, new_text string, allowed array<string>, n int").withColumn("keywords_added", F.array(F.lit("Zig")))
    got = [r["rule"] for r in V.validate_edits(edits, blocks).orderBy("n").collect()]
    assert got == [*V.RULES, None]
    assert sum(r["n"] for r in V.reject_log(V.validate_edits(edits, blocks)).collect()) == 7
    every = {r["n"]: r["rules"] for r in V.validate_edits_all(edits, blocks).collect()}
    assert every[2] == ["markup", "fabricated token"]
    accepted = V.validate_edits(edits, blocks).where("rule is null").select("doc_id", "block_id", "new_text")
    assert {r["block_id"]: r["text"] for r in V.apply_edits(blocks, accepted).collect()} == {"b1": base + " with Python", "h": "Experience"}


SAMPLE = """Job description

Collaborate with product and engineering teams to build things.

Key Responsibilities:
- Build pipelines

Minimum Qualification:
* 5+ years of experience in a similar role

Python is a plus
Familiarity with Docker
Role: Software Development - Other
Education
UG: Any"""


def test_structure_of_a_posting(spark):
    posts = spark.createDataFrame([(1, SAMPLE), (2, ""), (3, None)], "posting_id int, description string")
    got = {r["posting_id"]: r for r in E.structure_postings(posts).collect()}
    one = got[1]
    assert one["required"] == ["Minimum Qualification:", "5+ years of experience in a similar role"] and one["preferred"] == ["Python is a plus", "Familiarity with Docker"]
    assert one["responsibilities"] == ["Key Responsibilities:", "Build pipelines"] and one["title"] == "Collaborate with product and engineering teams to build things."
    assert one["other"] == ["Job description", "Collaborate with product and engineering teams to build things."] and got[2]["other"] == []


def test_text_functions(spark):
    assert values(spark, "t string", ["“a”  –  b\n\n\n\nc ﬁ"], X.normalise_text(F.col("t"))) == ['"a" - b\n\nc fi']
    assert values(spark, "t string", ["running", "nation", "bed", "boxes", "is", "cats"], X.crude_stem(F.col("t"))) == ["runn", "nation", "bed", "box", "is", "cat"]
    assert values(spark, "t string", ["Jan 2022 - Present", "2019 - 2021", "I know 12024", None], X.latest_year(F.col("t"))) == [2025, 2021, None, None]
    assert values(spark, "t string", ['x {"a": 1} y', '```json\n{"a": 2}\n```', '{"a": 3, "b"', "none", None], X.salvage_json(F.col("t"), "struct<a:int>")["a"]) == [1, 2, 3, None, None]
    marked = values(spark, "t string", ["Use c++ and C, not D"], V.highlight_segments(F.col("t"), ["C", "C++"]))[0]
    assert [(m["text"], m["marked"]) for m in marked] == [("Use ", False), ("c++", True), (" and ", False), ("C", True), (", not D", False)]


def test_tech_terms_end_at_marks(spark):
    assert values(spark, "t string", ["C++ and C#, not Gopher; go"], T.tech_terms(F.col("t"))) == [["C#", "C++", "go"]]


def test_skills_of_three_shapes(spark):
    rows = ['[{"category": "Data", "skills": [{"name": "sql", "level": 5}, {"name": "go"}]}, {"category": "None", "skills": []}]', '["a", " ", "b"]', "a, b\n\nc", "", None]
    got = [[(c["category"], [(s["name"], s["level"]) for s in c["skills"]]) for c in v] for v in values(spark, "t string", rows, X.normalise_skills(F.col("t")))]
    assert got == [[("Data", [("sql", 5), ("go", 3)])], [("Skills", [("a", 3), ("b", 3)])], [("Skills", [("a", 3), ("b", 3), ("c", 3)])], [], []]
