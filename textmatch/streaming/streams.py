"""Streams of postings and status events, each with the batch form it must agree with."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textmatch.operators.postings import anti_existing, dedup_batch
from textmatch.schemas import RESULT_PAGE
from textmatch.sources.landing import normalise_postings
from textmatch.sources.storage import new_path

#: Status events of runs: status is null where an event only tells of progress; message and kind make a log entry.
RUN_EVENTS = T.StructType(
    [T.StructField(c, t) for c, t in (("posting_id", T.LongType()), ("event_id", T.LongType()), ("ts", T.TimestampType()), ("status", T.StringType()), ("message", T.StringType()), ("kind", T.StringType()))]
)
STATUS_EVENTS = T.StructType([T.StructField(c, t) for c, t in (("posting_id", T.LongType()), ("event_id", T.LongType()), ("ts", T.TimestampType()), ("status", T.StringType()))])


def stream_postings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Postings of result pages as they land in a folder, normalised. A page that can't be read gives no rows."""
    pages = spark.readStream.schema(RESULT_PAGE).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return normalise_postings(pages.select(F.explode("data").alias("r")).select("r.*"))


def stream_dedup(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """First row of each key within the watermark; ts is a timestamp. Exact across restarts only with append_unseen."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def append_unseen(path: str, key: str, order: list[str]):
    """A foreachBatch function: the batch's first row of each key that isn't stored at path is appended.

    Every micro-batch writes its own folder, so one done again after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = dedup_batch(batch, key, order)
        if batch_id > 0:
            before = batch.sparkSession.read.parquet(path).where(F.col("batch") < batch_id)
            fresh = anti_existing(fresh, before, key)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day; a row later than the watermark is dropped by append mode."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(F.to_date("window.start").cast("string").alias("day"), "n")


def latest_status(events: DataFrame) -> DataFrame:
    """Newest status of each posting and its number of events; batch and stream alike."""
    newest = F.max(F.struct("ts", "event_id", "status"))
    return events.groupBy("posting_id").agg(newest.alias("m"), F.count(F.lit(1)).alias("n_events")).select("posting_id", F.col("m.status").alias("status"), "n_events")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which processors with state of their own need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


HISTORY = "posting_id long, status string, sub_status string, log array<string>, n_events long"


def status_history(events: DataFrame, running: str = "Tailoring") -> DataFrame:
    """Batch form of stream_status_history(): status, sub_status, log and n_events of each posting.

    The newest event with a status says the status, the newest with a message the sub-status. An event that says
    `running` starts a run, which clears the log; the log has the kind and message of all later events, and of that one.
    """
    at = F.struct("ts", "event_id")
    marked = events.withColumn("at", at)
    newest = marked.groupBy("posting_id").agg(
        F.max(F.when(F.col("status") == running, F.col("at"))).alias("run"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("at"))).alias("status"),
        F.max_by("message", F.when(F.col("message").isNotNull(), F.col("at"))).alias("sub_status"), F.count(F.lit(1)).alias("n_events"),
        F.collect_list(F.when(F.col("message").isNotNull(), F.struct("at", F.concat_ws(": ", "kind", "message").alias("entry")))).alias("entries"),
    )
    log = F.filter(F.sort_array("entries"), lambda e: F.col("run").isNull() | (e["at"] >= F.col("run")))
    return newest.select("posting_id", "status", "sub_status", F.transform(log, lambda e: e["entry"]).alias("log"), "n_events")


def _events_of(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """Events of one key in one batch, in order: (microseconds, event_id, *columns), nulls as None."""
    out = []
    for frame in rows:
        stamps = frame["ts"].astype("datetime64[us]").astype("int64")
        values = [frame[c].astype(object).where(frame[c].notna(), None) for c in columns]
        out += zip(stamps.tolist(), frame["event_id"].tolist(), *values, strict=True)
    return sorted(out, key=lambda e: e[:2])


class StatusHistory(StatefulProcessor):
    """Keeps each posting's status, sub-status and start of its run as a value, and the log of that run as a list.

    Events may come in any order: what counts is their time. The list holds one run's entries only.
    """

    def __init__(self, running: str = "Tailoring"):
        self.running = running

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "status string, status_us long, status_id long, sub_status string, sub_us long, sub_id long, run_us long, run_id long, n long")
        self.log = handle.getListState("log", "us long, event_id long, entry string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        none = (-(1 << 62), -1)
        known = self.now.get()
        status, said, sub, sub_at, run, n = (None, none, None, none, none, 0) if known is None else (known[0], (known[1], known[2]), known[3], (known[4], known[5]), (known[6], known[7]), known[8])
        before, fresh = run, []
        for us, event, is_now, message, kind in _events_of(rows, ["status", "message", "kind"]):
            at, n = (us, event), n + 1
            if is_now is not None and at > said:
                status, said = is_now, at
            if is_now == self.running and at > run:
                run = at
            if message is not None:
                if at > sub_at:
                    sub, sub_at = message, at
                fresh.append((us, event, message if kind is None else f"{kind}: {message}"))
        fresh = [e for e in fresh if e[:2] >= run]
        log = [tuple(e) for e in self.log.get()]
        if run > before:  # a new run: entries of the one before go
            log = [e for e in log if e[:2] >= run] + fresh
            if log:
                self.log.put(log)
            else:
                self.log.clear()
        elif fresh:
            self.log.appendList(fresh)
            log += fresh
        self.now.update((status, *said, sub, *sub_at, *run, n))
        yield pd.DataFrame({"posting_id": [key[0]], "status": [status], "sub_status": [sub], "log": [[e[2] for e in sorted(log)]], "n_events": [n]})

    def close(self) -> None:
        pass


def stream_status_history(events: DataFrame, running: str = "Tailoring") -> DataFrame:
    """status_history() on a stream, in update mode: a row for each posting that a batch tells of. Needs the RocksDB state store."""
    return events.groupBy("posting_id").transformWithStateInPandas(StatusHistory(running), HISTORY, "update", "none")


class StatusChanges(StatefulProcessor):
    """Keeps each posting's newest status and tells of its changes: -1 for the status that it leaves, +1 for the one it takes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us long, event_id long, status string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        newest = max((e for e in _events_of(rows, ["status"]) if e[2] is not None), key=lambda e: e[:2], default=None)
        changes: list[tuple[str, int]] = []
        if newest is not None and (known is None or newest[:2] > (known[0], known[1])):
            self.last.update(newest)
            if known is None or known[2] != newest[2]:
                changes = ([] if known is None else [(known[2], -1)]) + [(newest[2], 1)]
        yield pd.DataFrame({"status": pd.Series([c[0] for c in changes], dtype=object), "change": pd.Series([c[1] for c in changes], dtype="int64")})

    def close(self) -> None:
        pass


def status_changes(events: DataFrame) -> DataFrame:
    """(status, change) for every posting whose current status changes in a batch. Needs the RocksDB state store."""
    return events.groupBy("posting_id").transformWithStateInPandas(StatusChanges(), "status string, change long", "update", "none")


def run_status_counts(events: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Postings by current status after every batch: batch, status, n. Runs over all that is there, and goes on from the checkpoint.

    Each batch's changes are summed by status and added to the counts that the batch before left, a row a status. A batch
    done again after a failure replaces its own folder and reads the same one before, so nothing is counted twice.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("status").agg(F.sum("change").alias("n"))
        if batch_id > 0:
            sums = sums.unionByName(spark.read.schema("status string, n long").parquet(f"{path}/batch={batch_id - 1}"))
        counts = sums.groupBy("status").agg(F.sum("n").alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # a row a status

    writer = status_changes(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    with rocksdb(spark):
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("status string, n long, batch int").parquet(path)


#: What a run that was cut off is told by, as sub-status and as entry of its log.
INTERRUPTED, INTERRUPTED_ENTRY = "Error: the run was interrupted. Start it again to go on.", "error: the run was interrupted. Start it again to go on."


def stuck_runs(events: DataFrame, as_of: Column, timeout: str = "INTERVAL 1 DAY", running: str = "Tailoring") -> DataFrame:
    """Postings whose last status is running and older than the timeout: they go back to Pending with an error in their log."""
    newest = events.where("status is not null").groupBy("posting_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("m"))
    late = F.col("m.ts") < as_of - F.expr(timeout)
    back = {"status": F.lit("Pending"), "sub_status": F.lit(INTERRUPTED), "entry": F.lit(INTERRUPTED_ENTRY), "since": F.col("m.ts")}
    return newest.where((F.col("m.status") == running) & late).select("posting_id", *[v.alias(c) for c, v in back.items()])


class StuckRuns(StatefulProcessor):
    """Keeps each posting's last status; a timer fires once event time passes a running one by the timeout."""

    def __init__(self, timeout_ms: int, running: str = "Tailoring"):
        self.timeout_ms, self.running = timeout_ms, running

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, event_id long, status string")

    def _rows(self, keys: list, since: list) -> pd.DataFrame:
        n = len(keys)
        return pd.DataFrame({
            "posting_id": pd.Series(keys, dtype="int64"), "status": pd.Series(["Pending"] * n, dtype=object), "sub_status": pd.Series([INTERRUPTED] * n, dtype=object),
            "entry": pd.Series([INTERRUPTED_ENTRY] * n, dtype=object), "since_us": pd.Series(since, dtype="int64"),
        })

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        newest = max((e for e in _events_of(rows, ["status"]) if e[2] is not None), key=lambda e: e[:2], default=None)
        if newest is not None and (known is None or newest[:2] > (known[0], known[1])):
            self.last.update(newest)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if newest[2] == self.running:
                self.handle.registerTimer(newest[0] // 1000 + self.timeout_ms)
        yield self._rows([], [])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()
        hit = last is not None and last[2] == self.running
        if hit:
            self.last.update((last[0], last[1], "Pending"))
        yield self._rows([key[0]] if hit else [], [last[0]] if hit else [])

    def close(self) -> None:
        pass


def stream_stuck_runs(events: DataFrame, timeout_ms: int, late: str = "0 seconds", running: str = "Tailoring") -> DataFrame:
    """stuck_runs on a stream; needs the RocksDB state store."""
    grouped = events.withWatermark("ts", late).groupBy("posting_id")
    found = grouped.transformWithStateInPandas(StuckRuns(timeout_ms, running), "posting_id long, status string, sub_status string, entry string, since_us long", "append", "eventTime")
    return found.select("posting_id", "status", "sub_status", "entry", F.timestamp_micros("since_us").alias("since"))


def run_available(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Run a stream over all that is there, and return its result from the shared folder, with the number of its batch for updates."""
    spark = stream.sparkSession
    path, checkpoint = path or new_path(spark, "stream"), checkpoint or new_path(spark, "stream-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id if mode != 'complete' else 0}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with rocksdb(spark):
        writer.start().awaitTermination()
    if mode == "update":
        return spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.IntegerType())])).parquet(path)
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def newest_update(updates: DataFrame, key: str) -> DataFrame:
    """The row of each key that the latest batch wrote."""
    rest = [c for c in updates.columns if c not in (key, "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("u")).select(key, "u.*")
