"""The summary reads postings once and says what its parts say."""

import datetime

from textmatch.operators import dashboards as G

AS_OF = datetime.date(2024, 3, 10)


def test_summary_equals_its_parts(spark):
    statuses = ["Pending", "Tailoring", "Tailored", "Applied", "Skipped", None]
    rows = [(i, f"c{i % 12}" if i % 9 else " ", statuses[i % 6], None if i % 7 == 0 else i % 101, datetime.datetime(2024, 1, 20) + datetime.timedelta(days=i % 60)) for i in range(400)]
    rows += [(500, None, "Pending", 0, None)]
    postings = spark.createDataFrame(rows, "posting_id long, company string, status string, match_score int, created_at timestamp")
    keywords = spark.createDataFrame([([("a", True, "High"), ("b", False, "Low")],)], "keywords array<struct<kw string, present boolean, weight string>>")
    for some in (postings, postings.limit(0)):
        got = G.summary(some, keywords, AS_OF).first()
        assert got["stats"] == G.headline_stats(some).first()
        assert got["statuses"] == G.status_breakdown(some).first() and got["rates"] == G.conversion_rates(some).first()
        for part, want in (("timeline", G.daily_timeline(some, AS_OF)), ("histogram", G.score_histogram(some)), ("companies", G.top_companies(some)), ("keywords", G.top_keywords(keywords))):
            assert sorted(map(tuple, got[part])) == sorted(map(tuple, want.collect())), part


def test_postings_are_read_once(spark, tmp_path):
    rows = [(1, "c", "Pending", 5, datetime.datetime(2024, 3, 1))]
    spark.createDataFrame(rows, "posting_id long, company string, status string, match_score int, created_at timestamp").write.parquet(f"{tmp_path}/postings")
    postings = spark.read.parquet(f"{tmp_path}/postings")
    plan = G._counted(postings, AS_OF, 30)
    keywords = spark.createDataFrame([], "keywords array<struct<kw string, present boolean, weight string>>")
    text = G.summary(postings, keywords, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in text and plan.count() == 2
