"""What stands far into a text counts."""

from textmatch import plans
from textmatch.operators import terms as T


def test_facts_and_requirements_are_read_from_whole_texts(spark, tmp_path):
    far = "word " * 400
    rows = [(8, far + "from 2001 to 2024. 2+ years experience in go", "s"), (9, far, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = {n: {r[0]: r for r in plans.queries()[n](spark, str(tmp_path)).collect()} for n in ("y3_experience_span", "y6_candidate_facts", "y7_posting_requirements")}
    assert {k: r["span"] for k, r in run["y3_experience_span"].items()} == {8: 2024 - 2001, 9: 2015 + 0 - 2012}
    assert {k: r["years"] for k, r in run["y6_candidate_facts"].items()} == {8: 2024 - 2001, 9: 2015 + 0 - 2012}
    assert {k: r["min_years"] for k, r in run["y7_posting_requirements"].items()} == {8: 2, 9: 1}


def test_variants_of_any_length_are_found(spark):
    long = "one two three four five six seven eight"
    variants = spark.createDataFrame([("a", long), ("b", "six seven")], "term string, variant string")
    blocks = spark.createDataFrame([(1, 0, f"zero {long} nine", "skills", 2020)], "doc_id long, pos int, text string, section string, recency_year int")
    assert sorted((r["term"], r["matched_variant"]) for r in T.find_terms(variants, blocks).collect()) == [("a", long), ("b", "six seven")]
