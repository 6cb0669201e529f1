"""Weighted scoring of documents against a posting's terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmatch.functions.joins import lookup_join
from textmatch.sources.storage import stored

# Phrases that ask for a look by a person and never fail a document.
REVIEW_PHRASES = ("must be authorized", "no sponsorship", "us citizen", "security clearance required", "must be local")


@dataclass(frozen=True)
class ScoreConfig:
    """Shares of the four parts, placement by section, and how recency fades."""

    required: float = 55.0
    preferred: float = 25.0
    placement: float = 12.0
    recency: float = 8.0
    sections: tuple[tuple[str, float], ...] = (
        ("skills", 1.5), ("summary", 1.2), ("projects", 1.1), ("certifications", 1.1), ("experience", 1.0), ("education", 0.8), ("other", 0.6),
    )
    floor: float = 0.5
    fade_years: int = 8
    tolerance: int = 1
    recommendations: int = 10


def placement_weight(section: Column, config: ScoreConfig = ScoreConfig()) -> Column:
    """Weight of a section; unknown ones weigh as other."""
    out = F.lit(config.sections[-1][1])
    for name, weight in config.sections[:-1]:
        out = F.when(section == name, weight).otherwise(out)
    return out


def best_section(sections: Column, config: ScoreConfig = ScoreConfig()) -> Column:
    """The heaviest of an array of sections; the earlier in the table wins ties."""
    order = {name: i for i, (name, _) in enumerate(config.sections)}

    def place(s: Column) -> Column:
        out = F.lit(len(order))
        for name, i in order.items():
            out = F.when(s == name, i).otherwise(out)
        return out

    return F.array_max(F.transform(sections, lambda s: F.struct(placement_weight(s, config).alias("w"), (-place(s)).alias("i"), s.alias("s"))))["s"]


def recency_score(year: Column, as_of_year: int = 2025, config: ScoreConfig = ScoreConfig()) -> Column:
    """1 for this year or later, falling in a line to the floor at fade_years; unknown years get the floor. Three places."""
    age = F.lit(as_of_year) - year
    fading = F.round((1 - age * ((1 - config.floor) / config.fade_years)).cast("decimal(18,6)"), 3).cast("double")
    return F.when(year.isNull() | (age >= config.fade_years), F.lit(config.floor)).when(age <= 0, F.lit(1.0)).otherwise(fading)


def knockouts(facts: DataFrame, reqs: DataFrame, on: list[str], config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Whether a document passes the hard requirements: years short by `tolerance` at most, degree reached if strict.

    facts: on.., years, degree. reqs: on.., min_years, min_degree, strict_degree, description.
    """
    rows = facts.join(reqs, on)
    years_ok = F.col("min_years").isNull() | (F.col("years") >= F.greatest(F.lit(0), F.col("min_years") - config.tolerance))
    degree_ok = ~F.col("strict_degree") | (F.col("degree") >= F.col("min_degree"))
    flags = F.filter(F.array(*[F.lit(p) for p in REVIEW_PHRASES]), lambda p: F.contains(F.lower("description"), p))
    return rows.select(*on, "years", "min_years", years_ok.alias("years_ok"), degree_ok.alias("degree_ok"), flags.alias("review_flags"), (years_ok & degree_ok).alias("passes"))


def asked_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Each of docs (posting_id, doc_id) with every term of its posting, and the other columns of terms.

    The terms of a posting become one row, so that a small row a document meets it, however many terms there are in all.
    """
    columns = [c for c in terms.columns if c != "posting_id"]
    gathered = stored(terms.groupBy("posting_id").agg(F.collect_list(F.struct(*columns)).alias("__terms")))
    rows = lookup_join(docs.select("posting_id", "doc_id"), gathered, ["posting_id"], salt="doc_id", keys=docs.select("posting_id"))
    return rows.select("posting_id", "doc_id", F.explode("__terms").alias("__t")).select("posting_id", "doc_id", "__t.*")


def match_terms(terms: DataFrame, found: DataFrame, docs: DataFrame, as_of_year: int = 2025, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """Every term of every pair, matched or not, with its best section, placement and recency.

    terms: posting_id, term, is_required. docs: posting_id, doc_id, the pairs to score. found: from find_terms.
    """
    rows = asked_terms(docs.select("posting_id", "doc_id"), terms.select("posting_id", "term", "is_required")).join(found.hint("merge"), ["doc_id", "term"], "left")
    matched = F.col("sections_found").isNotNull()
    section = best_section(F.col("sections_found"), config)
    return rows.select(
        "posting_id", "doc_id", "term", "is_required", matched.alias("matched"), "matched_variant", "sections_found", section.alias("best_section"),
        F.when(matched, placement_weight(section, config)).alias("placement"), "last_year", F.when(matched, recency_score(F.col("last_year"), as_of_year, config)).alias("recency"),
    )


def one_place(x: Column) -> Column:
    return F.round(x.cast("decimal(18,6)"), 1).cast("double")


def aggregate_score(matches: DataFrame, knocked: DataFrame | None = None, config: ScoreConfig = ScoreConfig(), by: tuple[str, ...] = ("posting_id", "doc_id")) -> DataFrame:
    """Scores of each pair in one grouped pass.

    Shares of required and preferred terms matched (an empty set counts as all), the mean placement of matched terms
    scaled from its range, and the mean recency of matched required terms. Knocked out pairs score 0. One place.
    knocked: by.., passes.
    """
    required, hit = F.col("is_required"), F.col("matched")
    low, high = config.sections[-1][1], config.sections[0][1]
    rows = matches.groupBy(*by).agg(
        F.count_if(required).alias("n_required"), F.count_if(required & hit).alias("m_required"),
        F.count_if(~required).alias("n_preferred"), F.count_if(~required & hit).alias("m_preferred"),
        F.avg(F.when(hit, F.col("placement").cast("decimal(10,4)"))).cast("double").alias("p"),
        F.avg(F.when(hit & required, F.col("recency").cast("decimal(10,4)"))).cast("double").alias("r"),
    )

    def share(m: str, n: str) -> Column:
        return F.when(F.col(n) == 0, F.lit(100.0)).otherwise(F.col(m) / F.col(n) * 100)

    req, pref = share("m_required", "n_required"), share("m_preferred", "n_preferred")
    place = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("p") - low) / (high - low))) * config.placement, F.lit(0.0))
    fresh = F.coalesce(F.col("r") * config.recency, F.lit(0.0))
    total = F.greatest(F.lit(0.0), F.least(F.lit(100.0), req * config.required / 100 + pref * config.preferred / 100 + place + fresh))
    if knocked is None:
        rows = rows.withColumn("passes", F.lit(True))
    else:
        rows = rows.join(knocked.select(*by, "passes").hint("merge"), list(by), "left").withColumn("passes", F.coalesce("passes", F.lit(True)))
    parts = {"required_score": req, "preferred_score": pref, "placement_score": place, "recency_score": fresh, "ats_score": total}
    return rows.select(*by, *[F.when(F.col("passes"), one_place(v)).otherwise(F.lit(0.0)).alias(k) for k, v in parts.items()], "passes", "n_required", "m_required")


def recommendations(matches: DataFrame, as_of_year: int = 2025, config: ScoreConfig = ScoreConfig()) -> DataFrame:
    """What to change first, at most `recommendations` rows a pair: kind, term, rank.

    Required terms missing; required ones only in education or other; the first five preferred missing; required ones
    last seen more than four years ago in a strong section.
    """
    strong = F.col("best_section").isin("skills", "summary", "experience", "projects", "certifications")
    hit, required = F.col("matched"), F.col("is_required")
    kind = F.when(required & ~hit, 0).when(required & hit & ~strong, 1).when(~required & ~hit, 2).when(required & hit & strong & (F.col("last_year") < as_of_year - 4), 3)
    rows = matches.withColumn("__k", kind).where("__k is not null")
    within = Window.partitionBy("posting_id", "doc_id", "__k").orderBy("term")
    rows = rows.withColumn("__w", F.row_number().over(within)).where("__k <> 2 or __w <= 5")
    order = Window.partitionBy("posting_id", "doc_id").orderBy("__k", "term")
    names = F.array(*[F.lit(x) for x in ("add_required", "move_required", "add_preferred", "refresh")])
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.recommendations)
    return ranked.select("posting_id", "doc_id", "rank", "term", names[F.col("__k")].alias("kind"))
