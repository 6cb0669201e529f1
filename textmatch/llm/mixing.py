"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmatch.llm.common import lookup_join, stored, words_count

#: Ranks are cut into so many intervals; only the interval that holds a source's cut is sorted.
INTERVALS = 4096


def cyclic_weights(by_source: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """Weights dealt to sources in code point order, null last, repeating. by_source has one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    return by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))


def targets(by_source: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Words wanted from each source.

    by_source: source, source_size, weight. share times all words are divided by weight; no source gives more than
    cap times its own words, and what is above goes to the others by weight until none is above. Without weight, a source
    gives nothing. Sources ordered
    by cap * size / weight are capped first, so the level is that of the first source that stays below its cap; levels fall from there on.
    One row a source; this table has as many rows as there are sources, not documents.
    """
    sized = by_source.withColumn("limit", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.try_divide("limit", "weight"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = F.try_divide(
        F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    )
    levelled = sized.withColumn("level", level)
    cut = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.when(F.col("weight") > 0, F.least(F.col("limit"), F.coalesce(cut, F.lit(float("inf"))) * F.col("weight"))).otherwise(0.0)
    return levelled.withColumn("target", target).drop("limit", "ratio", "level", "weight")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A fixed number in (0, 1) for each doc_id and text, from 52 bits of an MD5."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    digest = F.md5(name)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def mix(
    docs: DataFrame,
    weights: DataFrame | tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    importance: str | None = None,
) -> DataFrame:
    """Give every document the number of copies the mix takes.

    docs: doc_id, text, source and any other columns; all are kept. Added: __size (words), __source_size, __target
    and __copies. weights: a tuple dealt in turn to the sources in code point order, or a table (source, weight),
    in which a missing or null weight is 0.

    Every document of a source is due target / source_size copies. The whole part of that is taken for certain; the
    rest is a Pareto order sample: documents are ranked by the odds of a fixed random number over the odds of their
    inclusion, and taken in that order up to a fixed size, the words still missing from the target. importance names
    a column of positive numbers that shifts inclusion within a source (odds are multiplied by it); without it,
    inclusion differs between sources only.

    The cut is found without sorting a source in one task: words are summed by rank interval, and only the interval
    in which a source's cut falls is ordered. What comes out is one threshold rank a source, and how many of the rows at
    that rank are taken.

    Defined results: null or empty text has size 0 and takes 0 words; null source is a source of its own; the fixed
    number comes from doc_id and text, so rows without doc_id, or with one id and several texts, are ranked one by one;
    rows repeated with one doc_id and text have one rank, and as many of them are taken as the target wants; equal ranks
    of different rows are ordered by doc_id, then size; an empty table gives an empty table. Clashing
    column names are safe, as working columns start with two underscores.
    """
    size = words_count(F.col("text"))
    factor = F.col(importance).cast("double") if importance else F.lit(1.0)
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    rows = docs.withColumns({"__size": size, "__u": uniform(F.col("doc_id"), F.col("text"), seed), "__factor": factor, "__key": key})
    compact = stored(rows.select("__key", "source", "doc_id", "__size", "__u", "__factor"))

    by_source = compact.groupBy("__key", "source").agg(F.sum("__size").alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double"))
        by_source = by_source.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").fillna({"weight": 0.0})
    else:
        by_source = cyclic_weights(by_source, weights)
    wanted = targets(by_source, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = stored(
        wanted.select(
            "__key", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
            F.floor(rate).alias("__whole"), (rate - F.floor(rate)).alias("__part"),
            (F.col("target") - F.floor(rate) * F.col("source_size")).alias("__rest"),
        )
    )

    def ranked(frame: DataFrame) -> DataFrame:
        odds = F.col("__part") / (1 - F.col("__part")) * F.col("__factor")
        rank = F.when(F.col("__part") > 0, F.col("__u") / (1 - F.col("__u")) / odds)
        out = lookup_join(frame, plan, ["__key"], salt="__u").withColumn("__rank", rank)
        return out.withColumn("__interval", F.floor(F.col("__rank") / (1 + F.col("__rank")) * INTERVALS))

    due = ranked(compact).where("__rank is not null and __size > 0 and __rest > 0")
    upto = Window.partitionBy("__key").orderBy("__interval").rowsBetween(Window.unboundedPreceding, -1)
    sums = due.groupBy("__key", "__interval", "__rest").agg(F.sum("__size").alias("__words"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__words").over(upto), F.lit(0)))
    edge = stored(sums.where("__before < __rest and __before + __words >= __rest").select("__key", "__interval", "__before"))

    # Equal rows are one row here, so the window holds different documents of one interval only.
    at_edge = lookup_join(due, edge, ["__key", "__interval"], salt="__u")
    tied = ["__rank", "doc_id", "__size"]
    at_edge = at_edge.groupBy("__key", "__interval", "__rest", "__before", *tied).agg(F.count(F.lit(1)).alias("__rows"))
    within = Window.partitionBy("__key").orderBy(*tied).rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("__before") + F.coalesce(F.sum(F.col("__size") * F.col("__rows")).over(within), F.lit(0))
    # A row is taken while less than half of it goes beyond what is wanted.
    wanted_rows = F.ceil((F.col("__rest") - so_far) / F.col("__size") - 0.5)
    taken = at_edge.withColumn("__take", F.least("__rows", wanted_rows)).where("__take > 0")
    last = taken.groupBy("__key").agg(F.max(F.struct(*tied, "__take", "__rows")).alias("__last"))
    cuts = stored(edge.join(last, "__key", "left").select("__key", F.col("__interval").alias("__edge"), "__last"))

    out = lookup_join(ranked(rows), cuts, ["__key"], "left", salt="__u")
    below = F.col("__interval") < F.col("__edge")
    own, cut = F.struct(*tied), F.struct(*[F.col(f"__last.{c}").alias(c) for c in tied])
    on_edge = (F.col("__interval") == F.col("__edge")) & (own <= cut)
    picked = F.coalesce(below | on_edge, below, F.lit(False)) & (F.col("__size") > 0)
    out = out.withColumn("__picked", picked)
    if cuts.where("__last.__take < __last.__rows").limit(1).count():  # of some equal rows, not all are taken
        part = F.coalesce((F.col("__last.__take") < F.col("__last.__rows")) & (own == cut), F.lit(False)) & F.col("__picked")
        among = _numbered(out.where(part)).withColumn("__picked", F.col("__number") <= F.col("__last.__take")).drop("__number")
        out = out.where(~part).unionByName(among)
    copies = (F.col("__whole") + F.col("__picked").cast("int")).cast("int")
    return out.select(*docs.columns, "__size", "__source_size", "__target", copies.alias("__copies"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of each __key numbered from 1 in any order, without bringing them together: partitions are counted first."""
    table = stored(rows.withColumn("__seq", F.monotonically_increasing_id())).withColumn("__slice", F.shiftright("__seq", 33))
    sums = table.groupBy("__key", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select("__key", "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0")))  # a row a key and partition
    inside = Window.partitionBy("__key", "__slice").orderBy("__seq")
    numbered = lookup_join(table.withColumn("__n1", F.row_number().over(inside)), sums, ["__key", "__slice"], salt="__seq")
    return numbered.withColumn("__number", F.col("__n0") + F.col("__n1")).drop("__seq", "__slice", "__n0", "__n1")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of docs."""
    taken = mix(docs, **options).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
