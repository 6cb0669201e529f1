"""Before / after comparison of scored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmatch.functions.text import tokens
from textmatch.operators.scoring import one_place

PARTS = ("required_score", "preferred_score", "placement_score", "recency_score", "ats_score")
PAIR = ["posting_id", "doc_id"]


def score_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every part before, after and as a difference; required gaps closed (0 at least); whether passing changed."""
    b = before.select(*PAIR, *[F.col(c).alias(f"before_{c}") for c in PARTS], (F.col("n_required") - F.col("m_required")).alias("__g"), F.col("passes").alias("__p"))
    a = after.select(*PAIR, *[F.col(c).alias(f"after_{c}") for c in PARTS], (F.col("n_required") - F.col("m_required")).alias("__h"), "passes")
    rows = b.join(a, PAIR)
    deltas = [one_place(F.col(f"after_{c}") - F.col(f"before_{c}")).alias(f"delta_{c}") for c in PARTS]
    kept = [f"{side}_{c}" for c in PARTS for side in ("before", "after")]
    return rows.select(*PAIR, *kept, *deltas, F.greatest(F.lit(0), F.col("__g") - F.col("__h")).cast("long").alias("gaps_closed"), (F.col("__p") != F.col("passes")).alias("knockout_changed"))


def yoe_status_label(required: Column, years: Column, tolerance: int = 1, partial: float = 0.7) -> Column:
    """not_required, satisfied, partial or not_satisfied."""
    return (
        F.when(required.isNull(), "not_required").when(years >= required - tolerance, "satisfied").when(years >= required * partial, "partial").otherwise("not_satisfied")
    )


def impact_level(required: Column, freq: Column) -> Column:
    """high: required and repeated; medium: either; low: neither."""
    return F.when(required & (freq >= 2), "high").when(required | (freq >= 2), "medium").otherwise("low")


def keyword_movement(before: DataFrame, after: DataFrame, freqs: DataFrame) -> DataFrame:
    """Terms of each pair: newly_added, already_present or still_missing, with impact, frequency and rank.

    before, after: match rows. freqs: posting_id, term, freq. A term lost is still missing.
    """
    b = before.select(*PAIR, "term", F.col("matched").alias("__b"), F.col("is_required").alias("__rb"))
    a = after.select(*PAIR, "term", F.col("matched").alias("__a"), F.col("is_required").alias("__ra"), "best_section")
    rows = b.join(a.hint("merge"), [*PAIR, "term"], "full_outer").join(freqs.select("posting_id", "term", "freq").hint("shuffle_hash"), ["posting_id", "term"], "left")
    was, now = F.coalesce("__b", F.lit(False)), F.coalesce("__a", F.lit(False))
    kind = F.when(now & ~was, "newly_added").when(now, "already_present").otherwise("still_missing")
    rows = rows.withColumns({"movement": kind, "is_required": F.coalesce("__ra", "__rb"), "freq": F.coalesce("freq", F.lit(0)).cast("long")})
    rows = rows.withColumn("impact", impact_level(F.col("is_required"), F.col("freq")))
    weight = F.when(F.col("impact") == "high", 0).when(F.col("impact") == "medium", 1).otherwise(2)
    order = Window.partitionBy(*PAIR, "movement").orderBy(weight, F.desc("freq"), "term")
    return rows.select(*PAIR, "term", "movement", "impact", "freq", "is_required", "best_section", F.row_number().over(order).alias("rank"))


def movement_summary(movement: DataFrame) -> DataFrame:
    """Counts of each kind, coverage after in percent, and required terms added and missing."""
    m = F.col("movement")
    out = movement.groupBy(*PAIR).agg(
        *[F.count_if(m == k).alias(k) for k in ("newly_added", "already_present", "still_missing")],
        F.count_if((m == "newly_added") & F.col("is_required")).alias("required_added"), F.count_if((m == "still_missing") & F.col("is_required")).alias("required_missing"),
        F.count(F.lit(1)).alias("total"),
    )
    share = one_place((F.col("total") - F.col("still_missing")) / F.col("total") * 100)
    return out.withColumn("coverage_after", share)


def change_cards(edits: DataFrame, movement: DataFrame, required_share: float = 55.0) -> DataFrame:
    """For each edit, the declared keywords that were missing and are now matched, the points they bring, label and rank.

    edits: doc_id, block_id, keywords_added. Both sides are compared in lower case.
    """
    total = movement.where("is_required").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("__total"))
    new = movement.where("movement = 'newly_added'").select(*PAIR, F.lower("term").alias("__k"), "is_required")
    said = edits.select("doc_id", "block_id", F.explode_outer("keywords_added").alias("kw")).withColumn("__k", F.lower("kw"))
    pairs = movement.select(*PAIR).distinct()
    rows = pairs.join(said.hint("merge"), "doc_id").join(new.hint("merge"), [*PAIR, "__k"], "left")
    cards = rows.groupBy(*PAIR, "block_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("is_required"), F.col("__k")))).alias("required_closed"),
        F.sort_array(F.collect_set(F.when(~F.col("is_required"), F.col("__k")))).alias("preferred_closed"),
    )
    cards = cards.join(total.hint("merge"), PAIR, "left")
    points = one_place(F.coalesce(F.size("required_closed") / F.col("__total") * required_share, F.lit(0.0)))
    n = F.size("required_closed") + F.size("preferred_closed")
    label = F.when(n >= 3, "high").when(n >= 1, "medium").otherwise("low")
    order = Window.partitionBy(*PAIR).orderBy(F.desc("points"), F.desc("n"), "block_id")
    return cards.withColumns({"points": points, "n": n, "label": label}).withColumn("rank", F.row_number().over(order)).drop("__total", "n")


def pass_band(required_score: Column, passes: Column) -> Column:
    """Band of a required score; knocked out is likely_filtered."""
    return F.when(~passes, "likely_filtered").when(required_score >= 85, "strong_pass").when(required_score >= 70, "likely_surfaced").when(required_score >= 50, "borderline").otherwise("likely_filtered")


def pass_bands(before: DataFrame, after: DataFrame) -> DataFrame:
    """Band before and after, and whether it changed."""
    b = before.select(*PAIR, pass_band(F.col("required_score"), F.col("passes")).alias("band_before"))
    a = after.select(*PAIR, pass_band(F.col("required_score"), F.col("passes")).alias("band_after"))
    return b.join(a, PAIR).withColumn("changed", F.col("band_before") != F.col("band_after"))


def strength_signals(matches: DataFrame, freqs: DataFrame, titles: DataFrame, facts: DataFrame, as_of_year: int = 2025) -> DataFrame:
    """Signals of each pair, one a row (signal, detail).

    titles: pair, posting_title, doc_title. facts: pair, years, min_years. Title words shared (two at least), the three
    most frequent matched required terms, years reached or short, a skills section, and how recent the matches are.
    """
    shared = F.size(F.array_intersect(tokens(F.col("posting_title")), tokens(F.col("doc_title"))))
    title = titles.where(shared >= 2).select(*PAIR, F.lit("title_match").alias("signal"), shared.cast("string").alias("detail"))
    top = matches.where("matched and is_required").join(freqs.select("posting_id", "term", "freq"), ["posting_id", "term"], "left")
    order = Window.partitionBy(*PAIR).orderBy(F.desc_nulls_last("freq"), "term")
    top = top.withColumn("__n", F.row_number().over(order)).where("__n <= 3").select(*PAIR, F.lit("top_term").alias("signal"), F.col("term").alias("detail"))
    gap = F.col("years") - F.col("min_years")
    years = facts.where("min_years is not null").select(*PAIR, F.when(gap >= 0, "years_ok").otherwise("years_gap").alias("signal"), gap.cast("string").alias("detail"))
    skills = matches.where("array_contains(sections_found, 'skills')").select(*PAIR).distinct().select(*PAIR, F.lit("skills_section").alias("signal"), F.lit("").alias("detail"))
    last = matches.where("matched").groupBy(*PAIR).agg((F.lit(as_of_year) - F.max("last_year")).alias("age"))
    recent = last.where("age <= 1 or age >= 3").select(*PAIR, F.when(F.col("age") <= 1, "recent").otherwise("dated").alias("signal"), F.col("age").cast("string").alias("detail"))
    return title.unionByName(top).unionByName(years).unionByName(skills).unionByName(recent)


def action_list(movement: DataFrame, n: int = 10) -> DataFrame:
    """Missing terms as actions: priority by impact, then frequency; at most n a pair."""
    rank = F.when(F.col("impact") == "high", 0).when(F.col("impact") == "medium", 1).otherwise(2)
    order = Window.partitionBy(*PAIR).orderBy(rank, F.desc("freq"), "term")
    rows = movement.where("movement = 'still_missing'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return rows.select(*PAIR, "rank", "term", F.col("impact").alias("priority"), "freq")


def full_report(delta: DataFrame, summary: DataFrame, bands: DataFrame, actions: DataFrame, cards: DataFrame) -> DataFrame:
    """One nested row a pair: scores, movement, bands, actions and change cards."""

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select(*PAIR, F.struct(*[c for c in df.columns if c not in PAIR]).alias(name))

    def many(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in df.columns if c not in (*PAIR, "rank")]))).alias(name))

    out = one(delta, "scoreDelta")
    for part in (one(summary, "keywordMovement"), one(bands, "passBand"), many(actions, "actionItems"), many(cards, "changeCards")):
        out = out.join(part.hint("merge"), PAIR, "left")
    return out


def headline_delta(before: Column, after: Column, fallback: Column, added: Column) -> Column:
    """Rounded scores before and after (fallback where unknown), their difference, and distinct keywords added."""
    b = F.floor(F.coalesce(before, fallback, F.lit(0.0)) + 0.5).cast("long")
    a = F.floor(F.coalesce(after, before, fallback, F.lit(0.0)) + 0.5).cast("long")
    return F.struct(b.alias("before"), a.alias("after"), (a - b).alias("diff"), F.size(F.array_distinct(F.flatten(added))).alias("n_added"))


def delta_label(x: Column) -> Column:
    """no change within a twentieth, else the signed number with one place."""
    shown = F.format_number(F.abs(x), 1)
    return F.when(F.abs(x) < 0.05, "no change").when(x > 0, F.concat(F.lit("+"), shown)).otherwise(F.concat(F.lit("-"), shown))
