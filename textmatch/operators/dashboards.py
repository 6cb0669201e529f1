"""Dashboard aggregates over postings. Each is one grouped pass over a few columns."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmatch.schemas import STATUSES
from textmatch.sources.storage import stored


def half_up(x: Column) -> Column:
    """Whole number nearest to a non-negative ratio, halves upwards."""
    return F.floor(x + 0.5).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as a whole number, 0 when whole is 0."""
    return F.when(whole > 0, half_up(part * 100 / whole)).otherwise(F.lit(0)).cast("long")


def headline_stats(postings: DataFrame) -> DataFrame:
    """total, mean of positive scores, tailored (with applied) and applied."""
    positive = F.when(F.col("match_score") > 0, F.col("match_score"))
    return postings.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(half_up(F.avg(positive)), F.lit(0)).alias("avg_match"),
        F.count_if(F.col("status").isin("Tailored", "Applied")).alias("tailored"),
        F.count_if(F.col("status") == "Applied").alias("applied"),
    )


def daily_timeline(postings: DataFrame, as_of: datetime.date, days: int = 30) -> DataFrame:
    """Postings of each of the last days, zero-filled. The range filter reaches the scan."""
    first = as_of - datetime.timedelta(days=days - 1)
    counts = postings.where(F.to_date("created_at").between(first, as_of)).groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return _filled(counts, as_of, days)


def _filled(counts: DataFrame, as_of: datetime.date, days: int) -> DataFrame:
    """Counts (day, n) of each of the last days, zero where there is none."""
    spark: SparkSession = counts.sparkSession
    frame = spark.range(1).select(F.explode(F.sequence(F.lit(as_of - datetime.timedelta(days=days - 1)), F.lit(as_of))).alias("day"))
    return F.broadcast(frame).join(counts.hint("merge"), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("count"))


#: Lower bounds of score bins, best first; scores below all of them, or none, go to the last bin.
BINS = ((90, "90+"), (80, "80s"), (70, "70s"), (60, "60s"))
LAST_BIN = "<60"
BIN_NAMES = [name for _, name in BINS] + [LAST_BIN]


def _bin(score: Column) -> Column:
    label = F.lit(LAST_BIN)
    for low, name in reversed(BINS):
        label = F.when(score >= low, name).otherwise(label)
    return label


def score_histogram(postings: DataFrame) -> DataFrame:
    """Counts in five score bins and their share of the largest; empty bins are there."""
    return _histogram(postings.agg(*[F.count_if(_bin(F.col("match_score")) == name).alias(name) for name in BIN_NAMES]))


def _histogram(row: DataFrame) -> DataFrame:
    """Bins from one row with a column for each."""
    bins = F.array(*[F.struct(F.lit(name).alias("bin"), F.col(f"`{name}`").alias("count")) for name in BIN_NAMES])
    largest = F.greatest(*[F.col(f"`{name}`") for name in BIN_NAMES])
    return row.select(largest.alias("m"), F.explode(bins).alias("b")).select("b.bin", "b.count", percent(F.col("b.count"), F.col("m")).alias("pct"))


def top_companies(postings: DataFrame, n: int = 8) -> DataFrame:
    """Companies with the most postings; ties by name; empty names left out."""
    named = postings.where(F.trim("company") != "")
    return named.groupBy("company").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "company").limit(n)


def top_keywords(keywords: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent keyword names over postings: keywords is an array of (kw, present, weight)."""
    rows = keywords.select(F.explode("keywords").alias("k")).select(F.trim("k.kw").alias("name"), "k.present").where("name <> ''")
    counted = rows.groupBy("name").agg(F.count_if("present").alias("present"), F.count_if(~F.coalesce("present", F.lit(False))).alias("missing"), F.count(F.lit(1)).alias("total"))
    return counted.orderBy(F.desc("total"), "name").limit(n)


def status_breakdown(postings: DataFrame) -> DataFrame:
    """Counts of all five statuses in one row, zero-filled."""
    return postings.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])


def conversion_rates(postings: DataFrame) -> DataFrame:
    """Four whole percentages of the funnel, 0 where nothing could convert."""
    return _rates(postings.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Tailored", "Applied", "Skipped")]))


def _rates(counts: DataFrame) -> DataFrame:
    """Rates from one row: total, tailored, applied, skipped."""
    total, applied, skipped, prepared = F.col("total"), F.col("applied"), F.col("skipped"), F.col("tailored") + F.col("applied")
    return counts.select(
        percent(prepared, total).alias("prepared_rate"), percent(applied, prepared).alias("apply_rate"),
        percent(applied, total).alias("overall_rate"), percent(skipped, total).alias("skip_rate"),
    )


def overview_counts(postings: DataFrame, minimum: int = 75) -> DataFrame:
    """ingested, passed, pending, tailored and applied."""
    return postings.agg(
        F.count(F.lit(1)).alias("ingested"), F.count_if(F.col("match_score") >= minimum).alias("passed"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Pending", "Tailored", "Applied")],
    )


def keyword_match_rate(keywords: DataFrame, n: int = 10) -> DataFrame:
    """Present share of the top keywords with its band."""
    rate = percent(F.col("present"), F.col("total"))
    return top_keywords(keywords, n).select("name", rate.alias("rate"), F.when(rate >= 70, "good").when(rate >= 40, "fair").otherwise("poor").alias("band"))


def bar_heights(counts: DataFrame, least: int = 4) -> DataFrame:
    """Share of the largest count in percent, at least `least` where there is any. counts: few rows (day or bin, count)."""
    largest = F.max("count").over(Window.partitionBy())
    height = percent(F.col("count"), largest)
    return counts.withColumn("height", F.when(F.col("count") > 0, F.greatest(height, F.lit(least))).otherwise(F.lit(0)).cast("long"))


def _counted(postings: DataFrame, as_of: datetime.date, days: int) -> DataFrame:
    """All counts that the summary needs, in one pass: by company, and by day of the range (null for all other days).

    `of` says which; a row a company and a row a day, stored, as every part of the summary reads it. Rows by day add up to
    those over everything.
    """
    day, first = F.to_date("created_at"), as_of - datetime.timedelta(days=days - 1)
    positive, bins = F.col("match_score") > 0, _bin(F.col("match_score"))
    rows = postings.select("match_score", "status", F.when(F.trim("company") != "", F.col("company")).alias("company"), F.when(day.between(first, as_of), day).alias("day"))
    grouped = rows.groupingSets([["company"], ["day"]], "company", "day").agg(
        F.grouping_id().alias("id"), F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("positives"), F.sum(F.when(positive, F.col("match_score"))).alias("points"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES], *[F.count_if(bins == name).alias(name) for name in BIN_NAMES],
    )
    return stored(grouped.withColumn("of", F.when(F.col("id") == 1, "company").otherwise("day")).drop("id"))


def summary(postings: DataFrame, keywords: DataFrame, as_of: datetime.date, days: int = 30) -> DataFrame:
    """All dashboard parts as one nested row. Postings are read once; each part is made from their counts, and has a bounded size."""

    def rows(df: DataFrame, name: str, order: list[str]) -> DataFrame:
        fields = F.struct(*order, *[c for c in df.columns if c not in order])
        return df.agg(F.sort_array(F.collect_list(fields)).alias(name))

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.struct(*df.columns).alias(name))

    counts, c = _counted(postings, as_of, days), F.col
    sums = ["n", "positives", "points", *[s.lower() for s in STATUSES], *BIN_NAMES]
    every = counts.where("of = 'day'").agg(*[F.coalesce(F.sum(f"`{x}`"), F.lit(0)).alias(x) for x in sums])
    stats = every.select(
        c("n").alias("total"), F.coalesce(half_up(c("points") / F.nullif("positives", F.lit(0))), F.lit(0)).alias("avg_match"), (c("tailored") + c("applied")).alias("tailored"), "applied",
    )
    by_day = counts.where("of = 'day' and day is not null").select("day", "n")
    companies = counts.where("of = 'company' and company is not null").select("company", c("n").alias("count")).orderBy(F.desc("count"), "company").limit(8)
    parts = [
        one(stats, "stats"), rows(_filled(by_day, as_of, days), "timeline", ["day"]), rows(_histogram(every), "histogram", ["bin"]),
        rows(companies, "companies", ["company"]), rows(top_keywords(keywords), "keywords", ["name"]),
        one(every.select(*[s.lower() for s in STATUSES]), "statuses"), one(_rates(every.withColumnRenamed("n", "total")), "rates"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out
