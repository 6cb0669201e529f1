"""Folders of Parquet files with a log of commits: appends that run at the same time store each key once."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.sources.storage import stored

#: Folders that the rows of one append are dealt to by their key, so that a check for conflicts reads few files.
BUCKETS = 16
#: Appends that may get in between before one gives up.
TRIES = 50


class Conflict(RuntimeError):
    """Another append has taken the number of this commit."""


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _log(path: str) -> str:
    return f"{path.rstrip('/')}/_commits"


def commits(spark: SparkSession, path: str, after: int = 0) -> Iterator[tuple[int, dict]]:
    """Numbers and entries of the commits of a folder in order, from the one after `after` on."""
    fs, path_of = _filesystem(spark, path)
    number = after + 1
    while fs.exists(path_of(f"{_log(path)}/{number:020d}.json")):
        lines = spark.read.text(f"{_log(path)}/{number:020d}.json").first()
        yield number, json.loads(lines[0])
        number += 1


def commit(spark: SparkSession, path: str, number: int, entry: dict) -> None:
    """Make an entry the commit of this number, or raise Conflict where there is one already.

    The file is created only if it is absent, whole at once: by a hard link on local disks, elsewhere by the file
    system's own exclusive create.
    """
    fs, path_of = _filesystem(spark, path)
    fs.mkdirs(path_of(_log(path)))
    name, text = f"{_log(path)}/{number:020d}.json", json.dumps(entry, sort_keys=True)
    uri = fs.makeQualified(path_of(name)).toUri()
    if uri.getScheme() == "file":
        target = urlparse(uri.toString()).path
        written = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(written, "w") as f:
            f.write(text + "\n")
        try:
            os.link(written, target)
        except FileExistsError as e:
            raise Conflict(name) from e
        finally:
            os.remove(written)
        return
    try:
        out = fs.create(path_of(name), False)
    except PySparkException as e:
        raise Conflict(name) from e
    except Exception as e:  # py4j's error of a Java exception
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            raise Conflict(name) from e
        raise
    out.write(bytearray((text + "\n").encode()))
    out.close()


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _table(spark: SparkSession, path: str, schema, entries: list[dict]) -> DataFrame | None:
    """Rows of some commits with their bucket, or None without any."""
    folders = [f"{path.rstrip('/')}/{e['data']}" for e in entries]
    frames = [spark.read.schema(f"{_ddl(schema)}, __bucket int").option("basePath", f).parquet(f) for f in folders]
    out = frames[0] if frames else None
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def read_committed(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of finished appends; files of appends that failed or are under way aren't seen."""
    table = _table(spark, path, schema, [e for _, e in commits(spark, path)])
    return spark.createDataFrame([], schema) if table is None else table.drop("__bucket")


def append_committed(fresh: DataFrame, path: str, key: str, by: str | None = None) -> int:
    """Append rows (one a key) whose key isn't stored at path, and return the number of the commit.

    The rows are written first, then the next number of the log is claimed. Where another append has claimed it in the
    meantime, only what that one wrote is looked at, in the buckets that both have: rows whose key it holds are
    left out, and the number after is tried. So of two appends of one key the first to commit stores it. A commit
    without rows is made as well, so that a retried append can tell that it is done.
    """
    spark = fresh.sparkSession
    rows, seen = fresh.withColumn("__bucket", bucket(key)), 0
    for _ in range(TRIES):
        new = list(commits(spark, path, seen))
        if new or seen == 0:
            rows = _unseen(rows, _table(spark, path, fresh.schema, [e for _, e in new]), key)
            seen = new[-1][0] if new else seen
            data = f"data-{uuid.uuid4().hex}"
            rows.write.partitionBy(*([by] if by else []), "__bucket").parquet(f"{path.rstrip('/')}/{data}")
        try:
            commit(spark, path, seen + 1, {"data": data, "key": key})
            return seen + 1
        except Conflict:
            continue
    raise RuntimeError(f"{TRIES} other appends came in between")


def _unseen(rows: DataFrame, held: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key isn't held, stored apart, so that what is written doesn't change when the folder does."""
    if held is None:
        return stored(rows)
    touched = [r[0] for r in rows.select("__bucket").distinct().collect()]  # BUCKETS rows at most
    keys = held.where(F.col("__bucket").isin(touched)).select("__bucket", key)
    return stored(rows.join(keys, ["__bucket", key], "left_anti").select(*rows.columns))
