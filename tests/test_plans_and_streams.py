"""Physical plans, stored tables and streams."""

import datetime
import re

from pyspark.sql import functions as F

from textmatch import plans
from textmatch.operators import postings as P
from textmatch.sources import landing as L
from textmatch.sources import views as V
from textmatch.sources.storage import new_path
from textmatch.streaming import streams as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(V.table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in text and re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>", text)


def test_term_joins_are_equi_joins(spark, sf):
    queries = plans.queries()
    for name in ("t14_find_terms", "s6_bm25_topk", "s4_lexical_candidates", "v4_validate_edits", "d3_keep_newest"):
        assert "CartesianProduct" not in plan(queries[name](spark, sf)), name
    assert "BroadcastNestedLoopJoin" not in plan(queries["t14_find_terms"](spark, sf))


def test_newest_per_key_is_limited_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(P.keep_newest(V.postings(spark, sf)))


def test_no_python_in_plans_but_at_the_seam(spark, sf):
    streams = {"w1_stream_postings", "w2_stream_dedup", "w3_stream_daily_counts", "w4_latest_status", "w5_stuck_runs", "w6_status_counts"}
    writers = {"a1_read_raw_postings", "a4_append_new", "a5_write_report", "a7_write_versions"}
    for name, f in plans.queries().items():
        if name not in streams | writers | {"u1_embedder", "s10b_projected_topk"}:
            assert not re.search("EvalPython|InPandas|InArrow", plan(f(spark, sf))), name


def test_appending_twice_adds_nothing(spark):
    path = new_path(spark, "postings")
    rows = spark.createDataFrame([("a", "t", "k1"), ("b", "t", "k1"), ("c", "t", "k2")], "company string, title string, composite_key string")
    assert L.append_new(rows, path).count() == 2
    assert sorted(r["company"] for r in L.append_new(rows, path).collect()) == ["a", "c"]


def test_broken_pages_give_no_rows(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"status": "OK", "data": [{"job_id": "1", "employer_name": "E", "job_state": "CA", "job_country": "US"}, {"job_id": null}]}')
    (tmp_path / "bad.json").write_text('{"status": "OK", "data": [{"job_id"')
    got = L.normalise_postings(L.read_raw_postings(spark, str(tmp_path))).orderBy("company").collect()
    assert [(r["company"], r["composite_key"], r["location"], r["salary"]) for r in got] == [("E", "1", "CA US", ""), ("Unknown", "unknown_unknown", "", "")]
    assert L.corrupt_pages(spark, str(tmp_path)).count() == 1


def test_keep_newest_is_idempotent(spark, sf):
    once = P.keep_newest(V.postings(spark, sf))
    assert sorted(once.collect()) == sorted(P.keep_newest(once).collect())


def events(spark, rows):
    stamp = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, i, stamp + datetime.timedelta(hours=h), s) for i, (k, h, s) in enumerate(rows)], "posting_id long, event_id long, ts timestamp, status string")


def land(spark, path, *batches):
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(S.STATUS_EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def test_unseen_keys_survive_a_restart(spark):
    source, sink, checkpoint = (new_path(spark, n) for n in ("in", "out", "check"))
    for rows in ([(1, 0, "Pending"), (1, 1, "Tailoring"), (2, 0, "Pending")], [(2, 3, "Tailored"), (3, 3, "Pending")]):
        stream = land(spark, source, rows)
        stream.writeStream.foreachBatch(S.append_unseen(sink, "posting_id", ["ts", "event_id"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        got = sorted((r["posting_id"], r["status"]) for r in spark.read.parquet(sink).collect())
    assert got == [(1, "Pending"), (2, "Pending"), (3, "Pending")]


def test_a_late_row_is_dropped(spark):
    path = new_path(spark, "in")
    stream = land(spark, path, [(1, 1, "a"), (1, 100, "a")], [(5, 150, "a")], [(2, 2, "late"), (3, 200, "a")], [(4, 300, "a")])
    got = {r["day"]: r["n"] for r in S.run_available(S.daily_counts(stream, "1 hour")).collect()}
    assert got["2024-01-01"] == 1


def test_stuck_runs_by_timer_and_in_batch(spark):
    rows = [(1, 0, "Tailoring"), (2, 0, "Tailoring"), (2, 5, "Tailored"), (3, 90, "Tailoring"), (4, 0, "Pending"), (5, 1, "Tailored"), (5, 2, "Tailoring")]
    later = [(9, 100, "Pending")]
    batch = S.stuck_runs(events(spark, rows + later), F.lit(datetime.datetime(2024, 1, 5, 4)), "INTERVAL 24 HOUR")
    want = sorted(r["posting_id"] for r in batch.collect())
    assert want == [1, 5]
    stream = land(spark, new_path(spark, "in"), rows, later, [(9, 101, "Pending")])
    got = S.run_available(S.stream_stuck_runs(stream, 24 * 3_600_000)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.collect()))
    assert {r["entry"] for r in got} == {S.INTERRUPTED_ENTRY} and {r["status"] for r in got} == {"Pending"}


def run_events(spark, rows):
    """(posting, hour, status, message, kind) with the place as event_id."""
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, i, start + datetime.timedelta(hours=h), s, m, e) for i, k, h, s, m, e in rows], S.RUN_EVENTS)


def test_history_is_that_of_a_batch_and_survives_a_restart(spark):
    first = [(0, 1, 0, None, "queued", "info"), (1, 1, 1, "Tailoring", None, None), (2, 1, 2, None, "step one", "info"), (3, 2, 0, "Tailoring", "start", "info"), (4, 3, 0, None, None, None)]
    second = [(5, 1, 3, "Pending", "Error: x", "error"), (6, 1, 5, "Tailoring", None, None), (7, 2, 4, "Tailored", "Pipeline complete", "success")]
    late = [(8, 1, 4, None, "of the run before", "info"), (9, 1, 6, None, "step one", None), (10, 2, 1, None, "late but of this run", "info"), (11, None, 0, "Pending", "no id", "info")]
    source, sink, checkpoint = (new_path(spark, n) for n in ("in", "out", "check"))
    done = []
    for rows in (first, second, late):
        done += rows
        run_events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(S.RUN_EVENTS).parquet(source)
        updates = S.run_available(S.stream_status_history(stream), "update", checkpoint, sink)  # a restart each time
        got = {r["posting_id"]: r for r in S.newest_update(updates, "posting_id").collect()}
        want = {r["posting_id"]: r for r in S.status_history(run_events(spark, done)).collect()}
        assert {k: tuple(r) for k, r in got.items()} == {k: tuple(r) for k, r in want.items()}
    assert got[1]["log"] == ["step one"] and got[1]["status"] == "Tailoring" and got[1]["n_events"] == 7
    assert got[2]["log"] == ["info: start", "info: late but of this run", "success: Pipeline complete"] and got[2]["sub_status"] == "Pipeline complete"
    assert got[3]["log"] == [] and got[3]["status"] is None


def test_counts_follow_current_status_after_every_batch(spark):
    from textmatch.operators.dashboards import status_breakdown

    batches = [
        [(1, 0, "Pending"), (2, 0, "Pending"), (3, 0, "Tailoring")], [(1, 1, "Tailoring"), (1, 2, "Tailored"), (4, 0, "Pending")], [(2, 5, "Applied"), (1, 1, "Skipped"), (3, 1, "Tailoring")], [(2, 6, "Pending"), (4, 1, "Skipped")],
    ]
    source, path, checkpoint = (new_path(spark, n) for n in ("in", "out", "check"))
    numbered, n = [], 0
    for rows in batches:
        numbered.append([(i, *r) for i, r in enumerate(rows, n)])
        n += len(rows)
    start = datetime.datetime(2024, 1, 1)

    def frame(rows):
        return spark.createDataFrame([(k, i, start + datetime.timedelta(hours=h), s) for i, k, h, s in rows], S.STATUS_EVENTS)

    for upto in range(1, len(numbered) + 1):
        frame(numbered[upto - 1]).coalesce(1).write.mode("append").parquet(source)
        counts = S.run_status_counts(spark.readStream.schema(S.STATUS_EVENTS).parquet(source), path, checkpoint)
        got = {r["status"].lower(): r["n"] for r in counts.where(F.col("batch") == upto - 1).collect()}
        want = status_breakdown(S.latest_status(frame([r for rows in numbered[:upto] for r in rows]))).first().asDict()
        assert {k: got.get(k, 0) for k in want} == want
    assert counts.where("n < 0").count() == 0


def test_pages_stream_as_they_land(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"status": "OK", "data": [{"job_id": "1", "employer_name": "E"}, {"job_id": null, "job_title": "T"}]}')
    (tmp_path / "b.json").write_text('{"status": "OK", "data": [{"job_id"')
    got = S.run_available(S.stream_postings(spark, str(tmp_path))).orderBy("company").collect()
    assert [(r["company"], r["composite_key"]) for r in got] == [("E", "1"), ("Unknown", "unknown_t")]
