"""Appends that get in each other's way."""

from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

from textmatch.sources import commits as C
from textmatch.sources import landing as L
from textmatch.sources.storage import new_path

SCHEMA = "company string, title string, composite_key string"


def rows_of(spark, who, keys):
    return spark.createDataFrame([(who, "t", f"k{k}") for k in keys], SCHEMA)


def test_an_append_in_between_keeps_its_rows(spark, monkeypatch):
    path, claim, tries = new_path(spark, "postings"), C.commit, []

    def late(spark, where, number, entry):
        tries.append(number)
        if len(tries) == 1:  # another job commits first
            monkeypatch.setattr(C, "commit", claim)
            L.append_new(rows_of(spark, "other", range(5, 15)), path)
            monkeypatch.setattr(C, "commit", late)
        claim(spark, where, number, entry)

    monkeypatch.setattr(C, "commit", late)
    table = L.append_new(rows_of(spark, "own", range(10)), path)
    assert tries == [1, 2]
    got = {r["composite_key"]: r["company"] for r in table.collect()}
    assert got == {f"k{k}": "own" if k < 5 else "other" for k in range(15)} and table.count() == 15


def test_parallel_appends_store_each_key_once(spark):
    path, start = new_path(spark, "postings"), Barrier(4)

    def run(i):
        start.wait()
        L.append_new(rows_of(spark, f"w{i}", range(3 * i, 3 * i + 12)), path, by="company")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(run, range(4)))
    table = C.read_committed(spark, path, rows_of(spark, "", [0]).schema)
    keys = [r["composite_key"] for r in table.collect()]
    assert sorted(keys) == sorted({f"k{k}" for k in range(21)})
    assert [n for n, _ in C.commits(spark, path)] == [1, 2, 3, 4]


def test_files_without_a_commit_are_not_read(spark):
    path = new_path(spark, "postings")
    L.append_new(rows_of(spark, "a", [1]), path)
    rows_of(spark, "b", [2]).withColumn("__bucket", C.bucket("composite_key")).write.partitionBy("__bucket").parquet(f"{path}/data-failed")
    assert L.append_new(rows_of(spark, "c", [1, 3]), path).count() == 2
    assert L.append_new(rows_of(spark, "c", []), path).count() == 2
    assert C.read_committed(spark, new_path(spark, "none"), rows_of(spark, "", [0]).schema).count() == 0
