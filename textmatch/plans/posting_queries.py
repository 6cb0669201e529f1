"""Queries over postings, profiles and versions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.operators import dashboards as G
from textmatch.operators import postings as P
from textmatch.plans.registry import query
from textmatch.sources import views as V

W = f"WITH {V.POSTINGS_SQL}"
AS_OF = datetime.date(2001, 7, 31)


def _p(spark: SparkSession, d: str) -> DataFrame:
    return V.postings(spark, d)


@query(f"{W} SELECT posting_id, company, match_score FROM postings WHERE status = 'Applied'")
def b1_filter_status(spark: SparkSession, d: str) -> DataFrame:
    return P.filter_status(_p(spark, d), "Applied").select("posting_id", "company", "match_score")


@query(f"{W} SELECT posting_id, company, title, status FROM postings WHERE posting_id = 77")
def b2_get_by_id(spark: SparkSession, d: str) -> DataFrame:
    return P.get_by_id(_p(spark, d), 77).select("posting_id", "company", "title", "status")


@query(f"{W} SELECT posting_id, p.profile_id, match_score FROM postings p JOIN (SELECT DISTINCT user_id AS profile_id, 70 + 5 * user_id AS min_score FROM events WHERE user_id < 3) USING (profile_id) WHERE match_score >= min_score")
def b3_filter_fit(spark: SparkSession, d: str) -> DataFrame:
    users = V.table(spark, d, "events").where("user_id < 3").select(F.col("user_id").alias("profile_id"), (70 + 5 * F.col("user_id")).alias("min_score")).distinct()
    return P.filter_fit(_p(spark, d), users).select("posting_id", "profile_id", "match_score")


@query(f"{W} SELECT posting_id, company, title FROM postings WHERE contains(lower(title), 'urgent') OR contains(lower(company), 'urgent')")
def b4_search_postings(spark: SparkSession, d: str) -> DataFrame:
    return P.search_postings(_p(spark, d), "URGENT").select("posting_id", "company", "title")


@query(f"{W} SELECT posting_id, status, created_at FROM postings WHERE status IN ('Pending', 'Tailored') ORDER BY created_at DESC, posting_id DESC LIMIT 10")
def b5_action_queue(spark: SparkSession, d: str) -> DataFrame:
    return P.action_queue(_p(spark, d)).select("posting_id", "status", "created_at")


@query(f"{W} SELECT posting_id, CASE status WHEN 'Tailoring' THEN 0 ELSE 1 END AS \"group\", CAST(row_number() OVER (PARTITION BY status ORDER BY created_at DESC, posting_id DESC) AS INTEGER) AS place FROM postings WHERE status IN ('Tailoring', 'Tailored')")
def b6_work_list(spark: SparkSession, d: str) -> DataFrame:
    return P.work_list(_p(spark, d)).select("posting_id", "group", "place")


@query(f"{W} SELECT posting_id, CASE WHEN posting_id % 10 = 0 THEN 'Skipped' ELSE status END AS status FROM postings")
def b7_set_status(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d)
    updates = p.where("posting_id % 5 = 0").select("posting_id", F.when(F.col("posting_id") % 10 == 0, "Skipped").otherwise("Unheard of").alias("status"))
    return P.set_status(p, updates).select("posting_id", "status")


@query(f"{W} SELECT posting_id FROM postings WHERE status <> 'Skipped'")
def b8_delete_rows(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d)
    return P.delete_rows(p, p.where("status = 'Skipped'")).select("posting_id")


@query(f"{W} SELECT posting_id, created_at FROM postings ORDER BY created_at DESC, posting_id DESC LIMIT 100")
def b9_latest_first(spark: SparkSession, d: str) -> DataFrame:
    return P.latest_first(_p(spark, d), 100).select("posting_id", "created_at")


@query(f"WITH {V.BLOCKS_SQL} SELECT doc_id, block_id AS id, block_type AS style, CASE block_type WHEN 'bullet' THEN 1 ELSE 0 END AS level, text FROM blocks")
def b10_project_blocks(spark: SparkSession, d: str) -> DataFrame:
    from textmatch.operators.blocks import project_blocks

    return project_blocks(V.blocks(spark, d))


@query(f"{W} SELECT posting_id, title FROM postings WHERE title LIKE '2-%' ORDER BY posting_id LIMIT 1")
def b11_filter_like(spark: SparkSession, d: str) -> DataFrame:
    return P.filter_like(_p(spark, d), "title", "2-%").select("posting_id", "title")


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def d1_anti_existing(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderstatus")
    return P.anti_existing(o, o.where("o_orderstatus = 'P'"), "key").select("key").distinct()


@query("SELECT o_custkey AS key, min(o_orderkey) AS first FROM orders GROUP BY o_custkey")
def d2_dedup_batch(spark: SparkSession, d: str) -> DataFrame:
    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("first"))
    return P.dedup_batch(o, "key", ["first"])


NEWEST = "row_number() OVER (PARTITION BY trim(lower(company || '|' || title)) ORDER BY created_at DESC, posting_id DESC)"


@query(f"{W} SELECT posting_id, company, title FROM (SELECT *, {NEWEST} AS n FROM postings) WHERE n = 1")
def d3_keep_newest(spark: SparkSession, d: str) -> DataFrame:
    return P.keep_newest(_p(spark, d)).select("posting_id", "company", "title")


@query(f"{W} SELECT posting_id FROM (SELECT *, {NEWEST} AS n FROM postings) WHERE n > 1")
def d3_duplicates_to_delete(spark: SparkSession, d: str) -> DataFrame:
    return P.duplicates_to_delete(_p(spark, d))


@query(f"{W}, k AS (SELECT *, coalesce(nullif(composite_key, ''), regexp_replace(lower(company || '-' || title), '\\s+', '_', 'g')) AS key FROM postings) SELECT key, max(posting_id) AS posting_id FROM k GROUP BY key")
def d4_display_dedup(spark: SparkSession, d: str) -> DataFrame:
    return P.display_dedup(_p(spark, d)).select("key", "posting_id")


@query(f"{W}, a AS (SELECT company, count(*) > 5 AS matched FROM postings WHERE status = 'Applied' GROUP BY company), b AS (SELECT company, count(*) > 3 AS matched FROM postings WHERE status = 'Skipped' GROUP BY company) SELECT company, coalesce(a.matched, false) AS before, coalesce(b.matched, false) AS after FROM a FULL OUTER JOIN b USING (company)")
def d5_snapshot_full_outer(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d)
    sides = [p.where(F.col("status") == s).groupBy("company").agg((F.count(F.lit(1)) > n).alias("matched")) for s, n in (("Applied", 5), ("Skipped", 3))]
    return P.snapshot_full_outer(*sides, "company")


@query(f"WITH {V.BLOCKS_SQL} SELECT d.doc_id, 'b' || CAST(d.doc_id % 9 AS VARCHAR) AS block_id, b.text IS NOT NULL AS known, coalesce(b.text, 'Original text not found') AS old_text FROM documents d LEFT JOIN blocks b ON b.doc_id = d.doc_id AND b.pos = d.doc_id % 9")
def d6_lookup_text(spark: SparkSession, d: str) -> DataFrame:
    edits = V.table(spark, d, "documents").select("doc_id", F.concat(F.lit("b"), (F.col("doc_id") % 9).cast("string")).alias("block_id"))
    return P.lookup_text(edits, V.blocks(spark, d)).select("doc_id", "block_id", "known", "old_text")


@query("WITH c AS (SELECT c_nationkey AS k, c_mktsegment AS claim, c_custkey FROM customer), r AS (SELECT n_nationkey AS k, substr(c_mktsegment, 1, 4) AS req, n_name FROM nation JOIN (SELECT DISTINCT c_mktsegment FROM customer) ON true) SELECT n_name, req, count(*) AS n FROM c JOIN r USING (k) WHERE contains(claim, req) OR contains(req, claim) GROUP BY ALL")
def d8_containment_join(spark: SparkSession, d: str) -> DataFrame:
    c = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("claim"))
    segments = c.select(F.substring("claim", 1, 4).alias("req")).distinct()
    reqs = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name").crossJoin(F.broadcast(segments))  # nations by market segments, both fixed
    return P.containment_join(c, reqs, ["k"], "claim", "req").groupBy("n_name", "req").agg(F.count(F.lit(1)).alias("n"))


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') SELECT k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL OUTER JOIN b USING (k)")
def d9_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    keys = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return P.set_algebra(keys.where("l_returnflag = 'R'").select("k"), keys.where("l_returnflag = 'A'").select("k"))


@query("SELECT p_partkey, p_brand AS name, p_size > 25 AS required FROM part WHERE p_size > 25 OR lower(p_brand) NOT IN (SELECT lower(p_brand) FROM part WHERE p_size > 48)")
def d10_prefer_required(spark: SparkSession, d: str) -> DataFrame:
    parts = V.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name"), "p_size", (F.col("p_size") > 25).alias("required"))
    top = parts.where("p_size > 48")
    kept = P.prefer_required(top, parts.where("p_size <= 48 and not required"))
    return kept.unionByName(parts.where("p_size between 26 and 48")).select("p_partkey", "name", "required")


@query(f"{W} SELECT posting_id, r_name AS profile, (posting_id + r_regionkey) % 7 = 0 AS fits FROM postings CROSS JOIN region")
def c5_pair_postings_profiles(spark: SparkSession, d: str) -> DataFrame:
    profiles = V.table(spark, d, "region").select(F.col("r_name").alias("profile"), "r_regionkey")
    return P.pair_postings_profiles(_p(spark, d).select("posting_id"), profiles).select("posting_id", "profile", ((F.col("posting_id") + F.col("r_regionkey")) % 7 == 0).alias("fits"))


@query(f"WITH {V.VERSIONS_SQL}, c AS (SELECT profile_id, max(version_id) AS v FROM versions WHERE profile_id % 2 = 0 GROUP BY profile_id) SELECT profile_id, version_id, CASE WHEN v IS NULL THEN is_current ELSE version_id = v END AS is_current FROM versions LEFT JOIN c USING (profile_id)")
def c6_set_current(spark: SparkSession, d: str) -> DataFrame:
    v = V.versions(spark, d)
    choice = v.where("profile_id % 2 = 0").groupBy("profile_id").agg(F.max("version_id").alias("version_id"))
    return P.set_current(v, choice).select("profile_id", "version_id", "is_current")


@query(f"WITH {V.VERSIONS_SQL} SELECT c_custkey AS profile_id, coalesce(content, c_name) AS content FROM customer LEFT JOIN (SELECT profile_id, arg_max(content, (created_at, version_id)) AS content FROM versions WHERE content IS NOT NULL GROUP BY profile_id) v ON v.profile_id = c_custkey")
def c7_latest_with_file(spark: SparkSession, d: str) -> DataFrame:
    profiles = V.table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_name").alias("text"))
    return P.latest_with_file(V.versions(spark, d), profiles)


@query(f"{W} SELECT count(*) AS total, CAST(coalesce(floor(avg(match_score) FILTER (match_score > 0) + 0.5), 0) AS BIGINT) AS avg_match, count(*) FILTER (status IN ('Tailored', 'Applied')) AS tailored, count(*) FILTER (status = 'Applied') AS applied FROM postings")
def g1_headline_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.headline_stats(_p(spark, d))


DAYS = "day AS (SELECT CAST(unnest(range(DATE '2001-07-02', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS day), t AS (SELECT day, CAST(count(posting_id) AS BIGINT) AS count FROM day LEFT JOIN postings ON CAST(created_at AS DATE) = day GROUP BY day)"


@query(f"{W}, {DAYS} SELECT CAST(day AS VARCHAR) AS day, count FROM t")
def g2_daily_timeline(spark: SparkSession, d: str) -> DataFrame:
    return G.daily_timeline(_p(spark, d), AS_OF).withColumn("day", F.col("day").cast("string"))


HIST = "h AS (SELECT bin, CAST(count(posting_id) AS BIGINT) AS count FROM (VALUES ('90+'), ('80s'), ('70s'), ('60s'), ('<60')) b(bin) LEFT JOIN postings ON bin = CASE WHEN match_score >= 90 THEN '90+' WHEN match_score >= 80 THEN '80s' WHEN match_score >= 70 THEN '70s' WHEN match_score >= 60 THEN '60s' ELSE '<60' END GROUP BY bin)"


@query(f"{W}, {HIST} SELECT bin, count, CAST(floor(count * 100.0 / max(count) OVER () + 0.5) AS BIGINT) AS pct FROM h")
def g3_score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return G.score_histogram(_p(spark, d))


@query(f"{W} SELECT company, count(*) AS count FROM postings WHERE trim(company) <> '' GROUP BY company ORDER BY count DESC, company LIMIT 8")
def g4_top_companies(spark: SparkSession, d: str) -> DataFrame:
    return G.top_companies(_p(spark, d))


TOP_KW = f"{V.KEYWORDS_SQL}, top AS (SELECT name, count(*) FILTER (present) AS present, count(*) FILTER (NOT present) AS missing, count(*) AS total FROM kw GROUP BY name ORDER BY total DESC, name LIMIT 10)"


@query(f"WITH {TOP_KW} SELECT * FROM top")
def g5_top_keywords(spark: SparkSession, d: str) -> DataFrame:
    return G.top_keywords(V.keywords(spark, d))


@query(f"{W} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("Pending", "Tailoring", "Tailored", "Applied", "Skipped")) + " FROM postings")
def g6_status_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return G.status_breakdown(_p(spark, d))


@query(f"{W}, n AS (SELECT count(*) AS total, count(*) FILTER (status = 'Tailored') AS t, count(*) FILTER (status = 'Applied') AS a, count(*) FILTER (status = 'Skipped') AS s FROM postings) SELECT CAST(floor((t + a) * 100.0 / total + 0.5) AS BIGINT) AS prepared_rate, CAST(floor(a * 100.0 / (t + a) + 0.5) AS BIGINT) AS apply_rate, CAST(floor(a * 100.0 / total + 0.5) AS BIGINT) AS overall_rate, CAST(floor(s * 100.0 / total + 0.5) AS BIGINT) AS skip_rate FROM n")
def g7_conversion_rates(spark: SparkSession, d: str) -> DataFrame:
    return G.conversion_rates(_p(spark, d))


SUMMARY_SQL = (
    f"{W}, {DAYS}, {HIST}, {TOP_KW}, c AS (SELECT company, count(*) AS count FROM postings WHERE trim(company) <> '' GROUP BY company ORDER BY count DESC, company LIMIT 8),"
    " n AS (SELECT count(*) AS total, count(*) FILTER (status IN ('Tailored', 'Applied')) AS prepared, count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Skipped') AS skipped FROM postings)"
)


@query(
    f"{SUMMARY_SQL} SELECT total, pending, CAST(floor(prepared * 100.0 / total + 0.5) AS BIGINT) AS prepared_rate, CAST(floor(skipped * 100.0 / total + 0.5) AS BIGINT) AS skip_rate,"
    " (SELECT string_agg(CAST(day AS VARCHAR) || ':' || count, '|' ORDER BY day) FROM t) AS timeline, (SELECT string_agg(bin || ':' || count, '|' ORDER BY bin) FROM h) AS histogram,"
    " (SELECT string_agg(company || ':' || count, '|' ORDER BY company) FROM c) AS companies, (SELECT string_agg(name || ':' || present || '/' || total, '|' ORDER BY name) FROM top) AS keywords FROM n"
)
def g8_summary(spark: SparkSession, d: str) -> DataFrame:
    """The nested row, its lists written out as text."""
    out = G.summary(_p(spark, d), V.keywords(spark, d), AS_OF)

    def text(c: str, item) -> Column:
        return F.array_join(F.transform(c, item), "|").alias(c)

    return out.select(
        "stats.total", "statuses.pending", "rates.prepared_rate", "rates.skip_rate", text("timeline", lambda x: F.concat_ws(":", x["day"].cast("string"), x["count"].cast("string"))),
        text("histogram", lambda x: F.concat_ws(":", x["bin"], x["count"].cast("string"))), text("companies", lambda x: F.concat_ws(":", x["company"], x["count"].cast("string"))),
        text("keywords", lambda x: F.concat(x["name"], F.lit(":"), x["present"].cast("string"), F.lit("/"), x["total"].cast("string"))),
    )


@query(f"{W} SELECT count(*) AS ingested, count(*) FILTER (match_score >= 75) AS passed, count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Tailored') AS tailored, count(*) FILTER (status = 'Applied') AS applied FROM postings")
def g9_overview_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.overview_counts(_p(spark, d))


@query(f"WITH {TOP_KW}, r AS (SELECT name, CAST(floor(present * 100.0 / total + 0.5) AS BIGINT) AS rate FROM top) SELECT name, rate, CASE WHEN rate >= 70 THEN 'good' WHEN rate >= 40 THEN 'fair' ELSE 'poor' END AS band FROM r")
def g10_keyword_match_rate(spark: SparkSession, d: str) -> DataFrame:
    return G.keyword_match_rate(V.keywords(spark, d))


@query(f"{W}, {DAYS} SELECT CAST(day AS VARCHAR) AS day, count, CASE WHEN count > 0 THEN greatest(CAST(floor(count * 100.0 / max(count) OVER () + 0.5) AS BIGINT), 4) ELSE 0 END AS height FROM t")
def g11_bar_heights(spark: SparkSession, d: str) -> DataFrame:
    return G.bar_heights(G.daily_timeline(_p(spark, d), AS_OF)).withColumn("day", F.col("day").cast("string"))
