"""Groups stay bounded as tables grow."""

import re

from pyspark.sql import functions as F

from textmatch.operators import postings as P
from textmatch.plans import flow_queries as Q
from textmatch.schemas import RAW_POSTING


def test_pages_hold_a_fixed_number_of_listings(spark):
    fields = [F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_POSTING]
    sizes = [r["n"] for r in Q._pages(spark.range(20_000).select(F.col("id").alias("o_orderkey"), *fields)).select(F.size("data").alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= Q.PAGE_SIZE


def test_work_list_is_numbered_over_ranges(spark):
    status = F.when(F.col("id") % 3 == 0, "Tailoring").when(F.col("id") % 3 == 1, "Tailored").otherwise("Pending")
    rows = spark.range(3000).select(F.col("id").alias("posting_id"), status.alias("status"), (F.col("id") % 50).alias("created_at"))
    out = P.work_list(rows)
    assert not re.search(r"Window \[row_number\(\)[^\n]*\], \[status#\d+\], \[", out._jdf.queryExecution().executedPlan().toString())
    got = {r["posting_id"]: (r["group"], r["place"]) for r in out.collect()}
    want = {}
    for group in (0, 1):
        ids = sorted(range(group, 3000, 3), key=lambda i: (i % 50, i), reverse=True)
        want |= {i: (group, n) for n, i in enumerate(ids, 1)}
    assert got == want
