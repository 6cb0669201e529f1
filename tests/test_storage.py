"""Stored tables, and what is broadcast."""

from pyspark.sql import functions as F

from textmatch.functions import joins
from textmatch.sources import storage


def test_bucketed_tables_leave_no_names(spark):
    before = spark.catalog.listTables()
    a, b = (storage.bucketed(spark.range(500).withColumn(c, F.col("id") % 7), ("id",)) for c in ("x", "y"))
    assert spark.catalog.listTables() == before
    both = a.join(b.hint("merge"), "id")
    assert both.count() == 500 and both.where("x = y").count() == 500
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    for _ in range(2):
        assert sorted(r["id"] for r in a.collect()) == list(range(500))


def test_stored_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    storage.stored(spark.range(3))
    storage.bucketed(spark.range(3), ("id",))
    (tmp_path / "other").mkdir()
    assert storage.remove_stored(spark) == 2 and storage.remove_stored(spark) == 0 and (tmp_path / "other").exists()


def test_broadcast_counts_all_types(spark):
    wide = spark.range(3000).select("id", F.array_repeat(F.lit(0.123456789), 1536).alias("vector"))
    assert not joins.fits_broadcast(wide) and joins.fits_broadcast(wide.limit(100))
    assert not joins.fits_broadcast(wide.select("id", F.struct("vector").alias("s")))
    assert joins.fits_broadcast(spark.range(50_000)) and not joins.fits_broadcast(spark.range(50_001))
    assert joins.fits_broadcast(spark.createDataFrame([(None, None)], "a string, b array<int>"))
