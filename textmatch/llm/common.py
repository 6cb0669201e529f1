"""Small helpers that the operators share: global order, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmatch.functions.joins import fits_broadcast, lookup_join
from textmatch.sources.storage import bucketed, stored

__all__ = ["bucketed", "components", "fits_broadcast", "lookup_join", "range_indexed", "sampled", "stored", "words_count"]


def sampled(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """Rows of docs whose doc_id is in ids (doc_id and other columns, a row an id, at most `most` of them): most rows at most.

    An id can stand on any number of rows, so these are counted before a text is read: ids go by their number of rows,
    then by the hash of doc_id, and those that would go beyond the bound are left out.
    """
    from pyspark.sql import Window

    held = docs.select("doc_id").join(F.broadcast(ids), "doc_id").groupBy(*ids.columns).agg(F.count(F.lit(1)).alias("__rows"))
    order = Window.orderBy("__rows", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = stored(held.withColumn("__upto", F.sum("__rows").over(order)).where(F.col("__upto") <= most).drop("__rows", "__upto"))
    return docs.join(F.broadcast(chosen), "doc_id")  # as many rows as ids

def range_indexed(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Number rows globally in the given order and add exclusive prefix sums, without a one-task sort.

    Rows are range-partitioned on the order, the partition number is stored with them, and prefix totals of the
    partitions (as many rows as there are partitions) are added to running sums inside each partition.
    Adds __idx (from 0) and, for each name: column of sums, the sum of the column over all earlier rows.
    """
    from pyspark.sql import Window

    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in order]
    table = stored(rows.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()))
    totals = table.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__t_{name}") for name, c in sums.items()])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__part",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        *[F.coalesce(F.sum(f"__t_{name}").over(before), F.lit(0)).alias(f"__o_{name}") for name in sums],
    )
    inside = Window.partitionBy("__part").orderBy(*keys)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = table.join(F.broadcast(offsets), "__part")  # one row a partition
    out = out.withColumn("__idx", F.col("__n0") + F.row_number().over(inside) - 1)
    for name, c in sums.items():
        out = out.withColumn(name, F.col(f"__o_{name}") + F.coalesce(F.sum(c).over(running), F.lit(0)))
    return out.drop("__part", "__n0", *[f"__o_{name}" for name in sums])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): a row (node, root) for every node of an edge, root being
    the component's smallest node.

    Each round every node takes its smallest neighbour (grouped minimum, combined before the shuffle), that map
    is followed one step further, and edges are rewritten between the chosen nodes; stars vanish in one round.
    Null ends and self loops are left out. Edges and maps stay in stored tables, never on the driver.
    """
    edges = stored(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")))
        onward = least.select(F.col("node").alias("m"), F.col("m").alias("m2"))
        step = stored(least.join(onward.hint("merge"), "m", "left").select("node", F.coalesce("m2", "m").alias("m")))
        maps.append(step)
        to_a, to_b = step.select(F.col("node").alias("a"), F.col("m").alias("ma")), step.select(F.col("node").alias("b"), F.col("m").alias("mb"))
        moved = edges.join(to_a.hint("merge"), "a").join(to_b.hint("merge"), "b")
        edges = stored(moved.where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    out = maps[-1].withColumnRenamed("m", "root")
    for step in reversed(maps[:-1]):
        onward = out.select(F.col("node").alias("m"), "root")
        out = stored(step.join(onward.hint("merge"), "m", "left").select("node", F.coalesce("root", "m").alias("root")))
    return out


def words_count(text: Column) -> Column:
    """Number of runs of non-white-space (ASCII white space) in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
