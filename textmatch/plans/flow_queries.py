"""Queries over ingestion, stored tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.plans.posting_queries import G, AS_OF
from textmatch.plans.registry import query
from textmatch.schemas import RAW_POSTING
from textmatch.sources import landing as L
from textmatch.sources import views as V
from textmatch.sources.storage import new_path
from textmatch.streaming import streams as S


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Orders as raw listings, with nulls by rule."""
    o = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    values = {
        "job_id": F.when(k % 3 == 0, F.concat(F.lit("j"), (k % 500).cast("string"))), "employer_name": F.when(k % 11 != 0, F.col("c_name")), "job_title": F.col("o_orderpriority"),
        "job_description": F.when(k % 2 == 0, "text"), "job_apply_link": F.lit(None), "job_city": F.when(k % 4 != 0, "Paris"), "job_state": F.when(k % 5 != 0, "IDF"),
        "job_country": F.when(k % 6 != 0, "FR"), "job_min_salary": F.when(k % 7 != 0, k % 90), "job_max_salary": F.when(k % 8 != 0, k % 90 + 10), "job_salary_currency": F.when(k % 9 != 0, "EUR"),
    }
    return o.select(k.alias("o_orderkey"), *[values[f.name].cast(f.dataType).alias(f.name) for f in RAW_POSTING])


CO, TI = "CASE WHEN k % 11 <> 0 THEN c_name ELSE 'Unknown' END", "o_orderpriority"
RAW_SQL = f"""raw AS (
    SELECT k, {CO} AS company, {TI} AS title, CASE WHEN k % 2 = 0 THEN 'text' ELSE '' END AS description, '' AS url,
        trim(CASE WHEN k % 4 <> 0 THEN 'Paris' ELSE '' END || ', ' || CASE WHEN k % 5 <> 0 THEN 'IDF' ELSE '' END || ' ' || CASE WHEN k % 6 <> 0 THEN 'FR' ELSE '' END, ', ') AS location,
        trim(coalesce(CAST(CASE WHEN k % 7 <> 0 THEN k % 90 END AS VARCHAR), '') || '-' || coalesce(CAST(CASE WHEN k % 8 <> 0 THEN k % 90 + 10 END AS VARCHAR), '') || ' ' || CASE WHEN k % 9 <> 0 THEN 'EUR' ELSE '' END, '- ') AS salary,
        'Pending' AS status, CASE WHEN k % 3 = 0 THEN 'j' || CAST(k % 500 AS VARCHAR) ELSE replace(lower({CO} || '_' || {TI}), ' ', '_') END AS composite_key
    FROM (SELECT *, o_orderkey AS k FROM orders) JOIN customer ON o_custkey = c_custkey)"""


#: Listings of a result page at most; the number of pages grows with the table.
PAGE_SIZE = 500


def _pages(raw: DataFrame) -> DataFrame:
    page = F.floor(F.col("o_orderkey") / PAGE_SIZE).alias("p")
    return raw.groupBy(page).agg(F.collect_list(F.struct(*[f.name for f in RAW_POSTING])).alias("data"))


@query(f"WITH {RAW_SQL} SELECT CAST(count(*) AS BIGINT) AS listings, count(DISTINCT title) AS titles, count(DISTINCT company) AS companies FROM raw")
def a1_read_raw_postings(spark: SparkSession, d: str) -> DataFrame:
    """Listings written as result pages with one that is cut off, and read back."""
    path = new_path(spark, "landing")
    pages = _pages(_raw(spark, d)).select("p", F.to_json(F.struct(F.lit("OK").alias("status"), "data")).alias("value"))
    broken = pages.where("p < 2").select(F.substring("value", 1, 50).alias("value"))
    pages.select("value").unionByName(broken).write.text(path)
    raw = L.read_raw_postings(spark, path, multi_line=False)
    return raw.agg(F.count(F.lit(1)).alias("listings"), F.countDistinct("job_title").alias("titles"), F.countDistinct(F.coalesce("employer_name", F.lit("Unknown"))).alias("companies"))


@query(f"WITH {RAW_SQL} SELECT company, title, description, url, location, salary, status, composite_key FROM raw")
def a2_normalise_postings(spark: SparkSession, d: str) -> DataFrame:
    return L.normalise_postings(_raw(spark, d))


@query(f"WITH {RAW_SQL}, p AS (SELECT composite_key, k, k % 3 AS r FROM raw), stored AS (SELECT composite_key, CASE WHEN bool_or(r < 2) THEN 'first' ELSE 'second' END AS batch FROM p GROUP BY composite_key) SELECT composite_key, batch, 1 AS n FROM stored")
def a4_append_new(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping batches appended, files parted by batch; each key is stored once, by the first that has it."""
    path, rows = new_path(spark, "postings"), _raw(spark, d)
    for name, part in (("first", "o_orderkey % 3 < 2"), ("second", "o_orderkey % 3 > 0")):
        table = L.append_new(L.normalise_postings(rows.where(part)).withColumn("batch", F.lit(name)), path, by="batch")
    return table.groupBy("composite_key", "batch").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(f"WITH {V.POSTINGS_SQL} SELECT '{{\"totalPostings\":' || CAST(count(*) AS VARCHAR) || ',\"openPostings\":' || CAST(count(*) FILTER (status = 'Pending') AS VARCHAR) || '}}' AS value FROM postings")
def a5_write_report(spark: SparkSession, d: str) -> DataFrame:
    rows = V.postings(spark, d).agg(F.count(F.lit(1)).alias("total_postings"), F.count_if(F.col("status") == "Pending").alias("open_postings"))
    return L.write_report(rows, new_path(spark, "report"))


@query(f"WITH {V.POSTINGS_SQL} SELECT posting_id % 12 AS run_id, count(*) AS fetched, count(*) FILTER (match_score >= 75) AS passed, count(*) FILTER (posting_id % 24 < 12 AND posting_id % 12 < 6) AS inserted, CASE WHEN count(*) FILTER (posting_id % 24 < 12 AND posting_id % 12 < 6) > 0 THEN 'new' ELSE 'nothing new' END AS status FROM postings GROUP BY 1")
def a6_ingest_run_stats(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("posting_id")
    return L.ingest_run_stats(V.postings(spark, d).select((k % 12).alias("run_id"), "match_score", ((k % 24 < 12) & (k % 12 < 6)).alias("is_new")))


@query(f"WITH {V.VERSIONS_SQL}, n AS (SELECT profile_id, arg_max(version_id, (created_at, version_id)) AS v FROM versions WHERE version_id % 10 = 0 GROUP BY profile_id) SELECT version_id, CASE WHEN v IS NULL THEN is_current ELSE version_id = v END AS is_current FROM versions LEFT JOIN n USING (profile_id)")
def a7_write_versions(spark: SparkSession, d: str) -> DataFrame:
    v = V.versions(spark, d)
    return L.write_versions(v.where("version_id % 10 <> 0"), v.where("version_id % 10 = 0"), new_path(spark, "versions")).select("version_id", "is_current")


def _landed(spark: SparkSession, d: str, files: int | None = None) -> DataFrame:
    """Events landed in files by time, in a folder of their own, and read as a stream; files: how many a batch reads."""
    events, path = V.table(spark, d, "events"), new_path(spark, "events")
    events.repartitionByRange(4, "ts").write.parquet(path)
    reader = spark.readStream.schema(events.schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return _status_events(_landed(spark, d))


def _status_events(events: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "Tailoring").when(F.col("event_type") == "purchase", "Tailored").otherwise("Pending")
    return events.select(F.col("user_id").alias("posting_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))


STATUS_SQL = "e AS (SELECT user_id AS posting_id, event_id, ts, CASE event_type WHEN 'click' THEN 'Tailoring' WHEN 'purchase' THEN 'Tailored' ELSE 'Pending' END AS status FROM events)"


@query(f"WITH {RAW_SQL} SELECT company, count(*) AS n FROM raw GROUP BY company")
def w1_stream_postings(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "landing")
    pages = _pages(_raw(spark, d))
    pages.select(F.lit("OK").alias("status"), "data").write.json(path)
    stream = S.stream_postings(spark, path, multi_line=False)
    return S.run_available(stream).groupBy("company").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {STATUS_SQL} SELECT posting_id, 1 AS n FROM e GROUP BY posting_id")
def w2_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = S.run_available(S.stream_dedup(_event_stream(spark, d), ["posting_id"], "60 days"))
    return rows.groupBy("posting_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(f"WITH {STATUS_SQL}, c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM e GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, n FROM c WHERE day < (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) FROM e)")
def w3_stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Days that the watermark has closed."""
    return S.run_available(S.daily_counts(_event_stream(spark, d)))


def _run_events(events: DataFrame) -> DataFrame:
    """Events as the steps of runs: a click starts one, views and signups tell of progress, a purchase or an error ends it."""
    kind = F.col("event_type")
    status = F.when(kind == "click", "Tailoring").when(kind == "purchase", "Tailored").when(kind == "error", "Pending")
    message = F.when(kind == "purchase", "Pipeline complete").when(kind == "error", F.concat(F.lit("Error: "), "props")).when(kind != "click", F.concat_ws(" ", "event_type", "props"))
    entry = F.when(kind == "purchase", "success").when(kind == "error", "error").otherwise("info")
    return events.select(F.col("user_id").alias("posting_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), message.alias("message"), entry.alias("kind"))


RUN_SQL = """r AS (
    SELECT user_id AS posting_id, event_id, ts, CASE event_type WHEN 'click' THEN 'Tailoring' WHEN 'purchase' THEN 'Tailored' WHEN 'error' THEN 'Pending' END AS status,
        CASE event_type WHEN 'purchase' THEN 'Pipeline complete' WHEN 'error' THEN 'Error: ' || props WHEN 'click' THEN NULL ELSE event_type || ' ' || props END AS message,
        CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'error' ELSE 'info' END AS kind
    FROM events)"""


@query(f"""WITH {RUN_SQL},
    started AS (SELECT posting_id, max((ts, event_id)) AS run FROM r WHERE status = 'Tailoring' GROUP BY posting_id),
    logs AS (
        SELECT posting_id, string_agg(kind || ': ' || message, chr(10) ORDER BY ts, event_id) AS log, count(*) AS n_entries
        FROM r LEFT JOIN started USING (posting_id) WHERE message IS NOT NULL AND (run IS NULL OR (ts, event_id) >= run) GROUP BY posting_id)
    SELECT posting_id, arg_max(status, (ts, event_id)) FILTER (status IS NOT NULL) AS status, arg_max(message, (ts, event_id)) FILTER (message IS NOT NULL) AS sub_status,
        count(*) AS n_events, coalesce(any_value(n_entries), 0) AS n_entries, coalesce(any_value(log), '') AS log
    FROM r LEFT JOIN logs USING (posting_id) GROUP BY posting_id""")
def w4_latest_status(spark: SparkSession, d: str) -> DataFrame:
    """Status, sub-status and the log of the current run of every posting, kept by a stream that reads files one at a time."""
    events = _run_events(_landed(spark, d, 1))
    now = S.newest_update(S.run_available(S.stream_status_history(events), "update"), "posting_id")
    return now.select("posting_id", "status", "sub_status", "n_events", F.size("log").cast("long").alias("n_entries"), F.array_join("log", "\n").alias("log"))


@query(f"WITH {STATUS_SQL}, l AS (SELECT posting_id, arg_max(status, (ts, event_id)) AS s, max(ts) AS since FROM e GROUP BY posting_id) SELECT posting_id, 'Pending' AS status, '{S.INTERRUPTED}' AS sub_status, '{S.INTERRUPTED_ENTRY}' AS entry, since FROM l WHERE s = 'Tailoring' AND since < (SELECT max(ts) FROM e) - INTERVAL 6 HOUR")
def w5_stuck_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs that no event has ended for six hours, by timers of a stream."""
    rows = S.run_available(S.stream_stuck_runs(_event_stream(spark, d), 6 * 3_600_000))
    return rows.withColumn("since", F.col("since").cast("timestamp_ntz"))


@query(f"WITH {STATUS_SQL}, l AS (SELECT posting_id, arg_max(status, (ts, event_id)) AS status FROM e GROUP BY posting_id) SELECT status, count(*) AS n FROM l GROUP BY status")
def w6_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Postings by current status, kept up by a stream of changes that reads files one at a time; the last batch's counts."""
    counts = S.run_status_counts(_status_events(_landed(spark, d, 1)), new_path(spark, "counts"), new_path(spark, "counts-checkpoint"))
    return counts.groupBy("status").agg(F.max_by("n", "batch").alias("n")).where("n > 0")


@query(f"WITH {V.POSTINGS_SQL} SELECT count(*) AS n FROM postings WHERE created_at >= DATE '2001-07-02' AND created_at < DATE '2001-08-01'")
def g2_timeline_total(spark: SparkSession, d: str) -> DataFrame:
    return G.daily_timeline(V.postings(spark, d), AS_OF).agg(F.sum("count").alias("n"))
