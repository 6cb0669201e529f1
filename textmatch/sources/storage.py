"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or one of our own where that is unset and Spark runs on this machine only."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends and sizes are known.

    by: a column of few values, each of which gets a folder of its own, so that reading one leaves the others alone.
    """
    path = new_path(df.sparkSession, "table")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Write df as a table in the shared folder that is bucketed and sorted by some columns, and read it back.

    There are as many buckets as shuffle partitions, so joins of such tables on these columns need no shuffle. The name
    that Spark asks for is taken out of the catalog again; the files stay, as does what the returned table knows of them.
    """
    spark = df.sparkSession
    name, buckets = f"bucketed_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("path", new_path(spark, "bucketed")).saveAsTable(name)
    table = spark.table(name)
    table.schema  # the table is looked up before its name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def remove_stored(spark: SparkSession) -> int:
    """Delete the tables that stored(), bucketed() and streams of finished queries left in the shared folder, and count them.

    For the end of a job: frames that were made from them can't be read any more.
    """
    jvm, folder = spark.sparkContext._jvm, shared_dir(spark)
    path_of = jvm.org.apache.hadoop.fs.Path
    fs = path_of(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(path_of(folder)) if s.getPath().getName().split("-")[0] in ("table", "bucketed", "stream")]
    return sum(fs.delete(p, True) for p in gone)
