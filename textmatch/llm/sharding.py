"""Balanced contiguous shards from global byte prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmatch.llm.common import range_indexed


def shards(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """Deal documents, in doc_id order, into n_shards contiguous shards of nearly equal bytes.

    A document weighs its UTF-8 bytes (null: none) plus overhead. The total of each range partition, summed over the
    partitions before it, turns running sums inside partitions into one global prefix sum; a document belongs to the
    shard in whose share of the total its middle byte falls, so each cut misses its target by half a document at most.

    Returns doc_id, size, text_crc32 (unsigned, of the UTF-8 bytes; null for null text), shard and slot (gapless from 0
    within the shard, in doc_id order). Only these 28 bytes a document are shuffled, never texts. A single document
    larger than a share leaves shards empty, as it cannot be cut. Null doc_ids come first; repeated doc_ids are ordered
    by checksum and size; an empty table gives an empty table.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long")
    rows = docs.select("doc_id", size.alias("size"), F.crc32("text").alias("text_crc32"))
    placed = range_indexed(rows, ["doc_id", "text_crc32", "size"], {"before": "size"})
    total = rows_total(placed)
    middle = 2 * F.col("before") + F.col("size")
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / (2 * total)).cast("int"))
    placed = placed.withColumn("shard", shard)
    first = placed.groupBy("shard").agg(F.min("__idx").alias("first"))
    out = placed.join(F.broadcast(first), "shard")  # n_shards rows at most
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("__idx") - F.col("first")).alias("slot"))


def rows_total(placed: DataFrame) -> F.Column:
    """All bytes, as a literal: one number from one aggregate."""
    return F.lit(placed.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0])
