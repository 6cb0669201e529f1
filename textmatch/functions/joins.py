"""Joins of large tables with tables of keys, whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.sources.storage import stored

#: A lookup side up to so many rows and bytes is broadcast; above either, it is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row, about: of strings and binaries their own, of arrays, maps and structs those of their JSON, else eight."""

    def size(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(F.col(f"`{f.name}`"))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`"))))
        return F.lit(8)

    return sum((F.coalesce(size(f), F.lit(0)).cast("long") for f in df.schema), F.lit(0).cast("long"))


def fits_broadcast(small: DataFrame) -> bool:
    """Whether a stored table is small enough to be sent to every task; its rows and bytes are counted."""
    n, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(small)), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def hot_keys(rows: DataFrame, on: list[str], parts: int = 64) -> DataFrame:
    """Keys with more than one of so many parts of the rows, fewer than there are parts, and how many parts they have: on.., __parts."""
    counts = stored(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    return stored(counts.where(F.col("__n") * parts > total).select(*on, F.ceil(F.col("__n") * parts / total).cast("int").alias("__parts")))


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salt: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Join a per-key table to the rows it describes.

    small must be stored already. Its rows and bytes are counted: up to the bounds above it is broadcast; beyond them both
    sides are shuffled, each key of small being repeated over 32 salts so that a hot key of big is spread. keys: big's
    rows with the columns of on, where these are told without big's work. They are counted, and only hot keys are
    repeated, 127 times in all at most, so that what moves of small isn't a multiple of it.
    """
    if fits_broadcast(small):
        return big.join(F.broadcast(small), on, how)
    salts = 32
    number = F.xxhash64(F.col(salt)) if salt else F.xxhash64(*[F.col(c) for c in big.columns])
    if keys is None:
        left = big.withColumn("__salt", F.pmod(number, F.lit(salts)).cast("int"))
        right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    else:
        hot = hot_keys(keys, on)
        missing = F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))  # meets nothing, so it can be anywhere
        parts = F.when(missing, F.lit(salts)).otherwise(F.coalesce("__parts", F.lit(1)))
        left = big.join(F.broadcast(hot), on, "left").withColumn("__salt", F.pmod(number, parts).cast("int")).drop("__parts")
        right = small.join(F.broadcast(hot), on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right.hint("shuffle_hash"), [*on, "__salt"], how).drop("__salt")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores, so that work on their texts is shared out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
