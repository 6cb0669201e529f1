"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.llm.common import bucketed, lookup_join, stored

#: ASCII white space, as stripped from both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class LineRuns:
    """A log-structured index of (line key, number of documents), kept as sorted runs in levels.

    A run is a table bucketed and sorted by key (h1, h2), so merging runs, or a batch with runs, is a merge join of
    buckets that needs no shuffle; only a new batch is shuffled, once, when it becomes a run. add() takes the next batch of
    (h1, h2, n), whose documents are in no other batch. It is merge-anti-joined with the settled runs, as their keys need
    no counting; what is left is merged with every run of the levels for the documents seen before. Keys that reach
    min_docs become a settled run, the others the batch's own run on level 0. A level that holds fanout runs is merged
    into one run of the next, counts of equal keys adding up; so are settled runs. So at any time the settled keys are
    those found in min_docs documents. Runs are tables in the shared folder: batches can come from separate jobs or a
    stream's foreachBatch, and a lost executor costs only the step in hand.
    """

    KEY = ("h1", "h2")

    def __init__(self, min_docs: int, fanout: int = 2):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        batch = self._run(batch.select(*self.KEY, F.col("n").cast("long").alias("n")))
        told = self._run(self.counted(batch))
        self.settled.append(told.where(F.col("total") >= self.min_docs).select(*self.KEY, "n"))
        if len(self.settled) >= self.fanout:
            self.settled = [self._compacted(self.settled)]
        self._put(0, told.where(F.col("total") < self.min_docs).select(*self.KEY, "n"))

    def counted(self, batch: DataFrame) -> DataFrame:
        """Keys of a batch that aren't settled, with n and the total over the batch and all runs."""
        for run in self.settled:
            batch = batch.join(run.hint("merge"), list(self.KEY), "left_anti")
        total = F.col("n")
        for i, run in enumerate(run for level in self.levels for run in level):
            batch = batch.join(run.withColumnRenamed("n", f"n{i}").hint("merge"), list(self.KEY), "left")
            total = total + F.coalesce(f"n{i}", F.lit(0))
        return batch.select(*self.KEY, "n", total.alias("total"))

    def merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """All keys of two runs, counts of equal keys added up."""
        both = a.withColumnRenamed("n", "n0").join(b.withColumnRenamed("n", "n1").hint("merge"), list(self.KEY), "full")
        return both.select(*self.KEY, (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"))

    def _compacted(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = self._run(self.merged(out, run))
        return out

    def frequent(self) -> DataFrame:
        """All keys found in min_docs documents or more so far."""
        out = self.settled[0].select(*self.KEY)
        for run in self.settled[1:]:
            out = out.unionByName(run.select(*self.KEY))
        return stored(out)

    def _run(self, rows: DataFrame) -> DataFrame:
        return bucketed(rows, self.KEY)

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            open_keys = []
            for old in self.levels[level]:
                for done in self.settled:
                    old = old.join(done.hint("merge"), list(self.KEY), "left_anti")
                open_keys.append(old)
            self.levels[level] = []
            self._put(level + 1, self._compacted(open_keys))


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case; other letters stay."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop the lines whose key is found in min_docs documents or more, in every document.

    docs: doc_id, text and any other columns; all are kept. Added: __kept (the remaining lines joined by newline),
    __n_lines, __n_dropped. Keys shorter than min_chars are never dropped.

    Documents come in batches by ascending doc_id; each batch's line hashes (96 bits a key) go through LineRuns.
    The settled keys are joined to line hashes, and only positions of dropped lines travel to the texts, so a line that
    a third of all documents share is moved as numbers and counted before the shuffle.

    Defined results: null or empty text is one empty line, which is kept; a document is a doc_id, so rows repeated with
    one doc_id count once, and each row without doc_id is a document of its own; equal lines inside a document count once;
    an empty table gives an empty table. Working columns start with two underscores, so other columns can have any name.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("__hash", F.xxhash64(text))
    nameless = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    key = line_key(F.col("line"))
    cuts = docs.agg(F.percentile_approx("doc_id", [b / batches for b in range(1, batches)])).first()[0] if batches > 1 else None
    batch = sum(((F.col("doc_id") > c).cast("int") for c in cuts or []), F.lit(0))
    lines = rows.select("doc_id", nameless.alias("row"), "__hash", F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("key", key)
    lines = lines.where(F.length("key") >= min_chars).select(
        F.coalesce(batch, F.lit(0)).alias("batch"), "doc_id", "row", "__hash", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"),
    )
    lines = stored(lines, "batch")

    runs = LineRuns(min_docs, fanout)
    for b in range(batches):
        once = lines.where(F.col("batch") == b).select("h1", "h2", "doc_id", "row").distinct()
        runs.add(once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")))
    frequent = runs.frequent()

    gone = lookup_join(lines, frequent, ["h1", "h2"], salt="doc_id")
    gone = gone.groupBy("doc_id", "__hash").agg(F.collect_set("pos").alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__h"), "__gone")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h"))
    joined = rows.join(gone.hint("merge"), same, "left")
    kept = F.when(F.col("__gone").isNull(), text).otherwise(_without(text, F.col("__gone")))
    return joined.select(
        *docs.columns,
        kept.alias("__kept"),
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("__n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__n_dropped"),
    )


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines at the given positions."""

    def one(text, positions):
        if positions is None:
            return None
        drop = set(positions.tolist())
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)

    return pd.Series([one(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)
