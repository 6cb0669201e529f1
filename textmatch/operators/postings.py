"""Filters, deduplication and updates over postings, profiles and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmatch.operators.substrings import substring_pairs
from textmatch.schemas import STATUSES
from textmatch.sources.storage import stored


def filter_status(postings: DataFrame, status: str | None = None) -> DataFrame:
    """Rows of one status, or all rows. The equality reaches the scan."""
    return postings if status is None else postings.where(F.col("status") == status)


def get_by_id(df: DataFrame, value: int, key: str = "posting_id") -> DataFrame:
    """Point lookup."""
    return df.where(F.col(key) == value)


def filter_fit(scored: DataFrame, profiles: DataFrame) -> DataFrame:
    """Postings whose score is known and reaches the profile's minimum; both sides carry profile_id."""
    minimum = profiles.select("profile_id", F.coalesce("min_score", F.lit(75)).alias("min_score"))
    return scored.join(minimum, "profile_id").where(F.col("match_score") >= F.col("min_score")).drop("min_score")


def search_postings(postings: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of title or company."""
    wanted = F.lit(text.lower())
    return postings.where(F.contains(F.lower("title"), wanted) | F.contains(F.lower("company"), wanted))


def action_queue(postings: DataFrame, n: int = 10) -> DataFrame:
    """The newest n postings that wait for an action."""
    return postings.where(F.col("status").isin("Pending", "Tailored")).orderBy(F.desc("created_at"), F.desc("posting_id")).limit(n)


def work_list(postings: DataFrame) -> DataFrame:
    """Postings in progress first, then finished ones, each newest first; order is the column place (from 1 per status).

    Ranges of the order are stored and numbered each by itself, after the counts of earlier ranges; no task sorts a status.
    """
    rows = postings.where(F.col("status").isin("Tailoring", "Tailored"))
    keys = [F.desc("created_at"), F.desc("posting_id")]
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = stored(rows.repartitionByRange(parts, "status", *keys).withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy("status").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = table.groupBy("status", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("status", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("status", "__part").orderBy(*keys)
    place = (F.col("__before") + F.row_number().over(inside)).cast("int")
    numbered = table.join(F.broadcast(before), ["status", "__part"]).withColumn("place", place)  # at most two rows a range
    return numbered.select(*rows.columns, F.when(F.col("status") == "Tailoring", 0).otherwise(1).alias("group"), "place")


def set_status(postings: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite statuses by posting_id; an unknown status is ignored. updates has one row a posting."""
    fresh = updates.where(F.col("status").isin(*STATUSES)).select("posting_id", F.col("status").alias("__new"))
    return postings.join(fresh, "posting_id", "left").withColumn("status", F.coalesce("__new", "status")).drop("__new")


def delete_rows(df: DataFrame, ids: DataFrame, key: str = "posting_id") -> DataFrame:
    """Rows whose key isn't listed."""
    return df.join(ids.select(key), key, "left_anti")


def latest_first(df: DataFrame, n: int, key: str = "posting_id") -> DataFrame:
    """The newest n rows."""
    return df.orderBy(F.desc("created_at"), F.desc(key)).limit(n)


def filter_like(df: DataFrame, column: str, pattern: str, key: str = "posting_id") -> DataFrame:
    """First row, by key, whose column matches a LIKE pattern."""
    return df.where(F.col(column).like(pattern)).orderBy(key).limit(1)


def anti_existing(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key isn't stored."""
    return new.join(existing.select(key), key, "left_anti")


def dedup_batch(new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row of each key inside a batch."""
    first = Window.partitionBy(key).orderBy(*order)
    return new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def posting_key() -> Column:
    """Company and title, lower-cased and trimmed."""
    return F.trim(F.lower(F.concat_ws("|", "company", "title")))


def _by_age() -> Window:
    return Window.partitionBy(posting_key()).orderBy(F.desc("created_at"), F.desc("posting_id"))


def keep_newest(postings: DataFrame) -> DataFrame:
    """The newest posting of each company and title."""
    return postings.withColumn("__n", F.row_number().over(_by_age())).where("__n = 1").drop("__n")


def duplicates_to_delete(postings: DataFrame) -> DataFrame:
    """All but the newest posting of each company and title. The newest are grouped maxima, so a company and title that many
    postings share is combined before it moves."""
    newest = postings.groupBy(posting_key()).agg(F.max(F.struct("created_at", "posting_id"))["posting_id"].alias("posting_id"))
    return postings.select("posting_id").join(newest.select("posting_id").hint("shuffle_hash"), "posting_id", "left_anti")


def display_dedup(postings: DataFrame) -> DataFrame:
    """One row per composite key, or per company and title where that is empty; the last posting_id wins."""
    made = F.regexp_replace(F.lower(F.concat_ws("-", "company", "title")), r"\s+", "_")
    keyed = postings.withColumn("key", F.coalesce(F.nullif("composite_key", F.lit("")), made))
    last = keyed.groupBy("key").agg(F.max("posting_id").alias("posting_id"))
    return last.join(postings, "posting_id").select("key", *postings.columns)


def snapshot_full_outer(before: DataFrame, after: DataFrame, key: str, flag: str = "matched") -> DataFrame:
    """Union of the keys of two snapshots with the flag on each side, false where a side lacks the key."""
    a, b = before.select(key, F.col(flag).alias("before")), after.select(key, F.col(flag).alias("after"))
    joined = a.join(b, key, "full_outer")
    return joined.select(key, F.coalesce("before", F.lit(False)).alias("before"), F.coalesce("after", F.lit(False)).alias("after"))


def lookup_text(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edits with their block's text; known tells whether there is such a block."""
    texts = blocks.select("doc_id", "block_id", F.col("text").alias("old_text"), F.lit(True).alias("known"))
    out = edits.join(texts.hint("merge"), ["doc_id", "block_id"], "left")
    return out.withColumn("known", F.coalesce("known", F.lit(False))).withColumn("old_text", F.coalesce("old_text", F.lit("Original text not found")))


def containment_join(claims: DataFrame, reqs: DataFrame, on: Sequence[str], claim: str, req: str) -> DataFrame:
    """Pairs inside a key where one string contains the other.

    Distinct strings are paired by substring_pairs(), both ways, and rows are joined to what their strings were paired with.
    """
    on = list(on)
    left, right = claims.select(*on, F.col(claim).alias("c")), reqs.select(*on, F.col(req).alias("r"))
    inner = substring_pairs(right.withColumnRenamed("r", "needle"), left.withColumnRenamed("c", "haystack"), on).select(*on, F.col("haystack").alias("c"), F.col("needle").alias("r"))
    outer = substring_pairs(left.withColumnRenamed("c", "needle"), right.withColumnRenamed("r", "haystack"), on).select(*on, F.col("needle").alias("c"), F.col("haystack").alias("r"))
    pairs = stored(inner.unionByName(outer).distinct().select(*on, F.col("c").alias("__claim"), F.col("r").alias("__req")))
    joined = reqs.withColumn("__req", F.col(req)).join(pairs.hint("merge"), [*on, "__req"])
    return joined.join(claims.withColumn("__claim", F.col(claim)).hint("merge"), [*on, "__claim"]).drop("__claim", "__req")


def prefer_required(required: DataFrame, preferred: DataFrame, name: str = "name") -> DataFrame:
    """Required rows, and preferred ones whose lower-cased name isn't required."""
    taken = required.select(F.lower(name).alias("__k")).distinct()
    rest = preferred.withColumn("__k", F.lower(name)).join(taken, "__k", "left_anti").drop("__k")
    return required.unionByName(rest)


def set_algebra(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of either side with what they belong to: both, left or right."""
    tagged = left.distinct().withColumn("__s", F.lit(1)).unionByName(right.distinct().withColumn("__s", F.lit(2)))
    side = F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("both")), F.col("__sum").cast("int"))
    return tagged.groupBy(*left.columns).agg(F.sum("__s").alias("__sum")).select(*left.columns, side.alias("side"))


def pair_postings_profiles(postings: DataFrame, profiles: DataFrame, on: Sequence[str] | None = None, block: int = 1000) -> DataFrame:
    """Every posting with every profile, or with those that share the tenant key.

    Without a key all pairs are asked for. Profiles are packed in blocks of about `block`, and each posting meets every
    block once, in one of 32 tasks a block: nothing is broadcast, whatever the number of profiles.
    """
    if on:
        return postings.join(profiles, list(on))
    salts, n = 32, max(1, -(-profiles.count() // block))
    row = F.struct(*profiles.columns)
    packed = profiles.groupBy(F.pmod(F.xxhash64(*profiles.columns), F.lit(n)).cast("int").alias("__block")).agg(F.collect_list(row).alias("__rows"))
    packed = packed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = postings.withColumn("__salt", F.pmod(F.xxhash64(*postings.columns), F.lit(salts)).cast("int")).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = dealt.join(packed.hint("merge"), ["__block", "__salt"])
    return met.select(*postings.columns, F.explode("__rows").alias("__row")).select(*postings.columns, *[F.col(f"__row.{c}").alias(c) for c in profiles.columns])


def set_current(versions: DataFrame, choice: DataFrame) -> DataFrame:
    """Mark one version of each profile in choice (profile_id, version_id) as current; other profiles keep theirs."""
    picked = choice.select("profile_id", F.col("version_id").alias("__v"))
    marked = F.when(F.col("__v").isNull(), F.col("is_current")).otherwise(F.col("version_id") == F.col("__v"))
    return versions.join(picked, "profile_id", "left").withColumn("is_current", marked).drop("__v")


def latest_with_file(versions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Content of each profile's newest version that has any, else the profile's own text."""
    order = F.struct("created_at", "version_id")
    newest = versions.where(F.col("content").isNotNull()).groupBy("profile_id").agg(F.max_by("content", order).alias("__c"))
    return profiles.join(newest, "profile_id", "left").select("profile_id", F.coalesce("__c", "text").alias("content"))
