"""Which strings contain which, by an index of their character runs: a string is looked up by its rarest run only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmatch.sources.storage import stored

#: Characters of a run.
Q = 4


def _runs(text: Column, n: Column | int) -> Column:
    """Distinct runs of n characters; none of a text that is shorter."""
    n = F.lit(n) if isinstance(n, int) else n
    last = F.length(text) - n + 1
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.substring(text, i, n))
    return F.when(last >= 1, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def substring_candidates(needles: DataFrame, haystacks: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Distinct pairs that may be needle and haystack: on.., needle, haystack. See substring_pairs()."""
    on = list(on)
    small = needles.select(*on, "needle").where(F.length("needle") > 0).distinct().withColumn("__n", F.least(F.lit(Q), F.length("needle")))
    small = stored(small)
    lengths = sorted(r[0] for r in small.select("__n").distinct().collect())  # Q rows at most
    large = stored(haystacks.select(*on, "haystack").where("haystack is not null").distinct().withColumn("__h", F.monotonically_increasing_id()))
    runs = F.flatten(F.array(*[_runs(F.col("haystack"), n) for n in lengths or [1]]))
    index = stored(large.select(*on, "__h", F.explode(runs).alias("__run")))
    often = index.groupBy(*on, "__run").agg(F.count(F.lit(1)).alias("__often"))
    own = small.withColumn("__all", F.size(_runs(F.col("needle"), F.col("__n")))).select(*on, "needle", "__all", F.explode(_runs(F.col("needle"), F.col("__n"))).alias("__run"))
    known = own.join(often.hint("shuffle_hash"), [*on, "__run"])
    # A needle with a run that no haystack has is in none.
    rarest = known.groupBy(*on, "needle", "__all").agg(F.count(F.lit(1)).alias("__known"), F.min_by("__run", F.struct("__often", "__run")).alias("__run")).where("__known = __all")
    met = index.join(rarest.select(*on, "needle", "__run").hint("shuffle_hash"), [*on, "__run"]).select("__h", "needle")
    return met.join(large.hint("merge"), "__h").select(*on, "needle", "haystack")


def substring_pairs(needles: DataFrame, haystacks: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Distinct pairs of strings of which one contains the other, within equal keys: on.., needle, haystack.

    needles: on.., needle. haystacks: on.., haystack. Every haystack is indexed by its runs of Q characters (and of the
    lengths of shorter needles). A needle is looked up by that of its runs which the fewest haystacks of its key have, so
    what is tried goes with how often that occurs, not with the product of both sides. White space is a character like
    others. Null strings and null keys pair with nothing; an empty needle is in every haystack of its key.
    """
    on = list(on)
    held = substring_candidates(needles, haystacks, on).where(F.contains("haystack", "needle"))
    empty = needles.where("needle = ''").select(*on, "needle").distinct()
    every = haystacks.select(*on, "haystack").where("haystack is not null").distinct()
    beside = every.join(empty.hint("merge"), on) if on else every.crossJoin(F.broadcast(empty.limit(1)))  # one row
    return held.unionByName(beside.select(*on, "needle", "haystack"))
