"""Years of experience, degrees, extracted facts and checks of extracted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmatch.functions.text import experience_span, matches, salvage_json

# How years of experience are asked for and claimed.
ASKED = r"(?i)([0-9]+)\+?\s*(?:to\s*[0-9]+\s*)?(?:years?|yrs?)(?:\s+(?:of\s+)?(?:experience|exp|work))?(?:\s+(?:in|with|using|of)\s+([^\n,;.]{3,40}))?"
CLAIMED = r"(?i)([0-9]+)\+?\s*(?:years?|yrs?)\s+(?:of\s+)?(?:experience|exp)\s+(?:in|with)?\s*([^\n,;.]{3,40})"
# Contexts that name no skill.
GENERIC = (
    "a similar role", "similar role", "this role", "the field", "related field", "similar position", "the industry", "relevant experience", "relevant field",
    "a related field",
)
# Degree words by level.
DEGREES = (
    ("phd", 5), ("doctorate", 5), ("masters", 4), ("master", 4), ("msc", 4), ("ms", 4), ("mba", 4), ("bachelors", 3), ("bachelor", 3), ("bsc", 3), ("bs", 3),
    ("btech", 3), ("associate", 2), ("diploma", 2), ("any", 1), ("graduate", 1), ("none", 0),
)
DEGREE_NAMES = ("None", "Any Graduate", "Diploma/Associate", "Bachelor's", "Master's", "PhD")


def yoe_requirements(postings: DataFrame, distinct: bool = True) -> DataFrame:
    """Years asked for: posting_id, pos, years, context, is_generic, in order of mention in `text`.

    Of equal (years, context) the first stays, unless distinct is off. A context is generic if listed, of two words at
    most, or empty.
    """
    text = F.col("text")
    found = F.arrays_zip(matches(text, ASKED, 1).alias("n"), matches(text, ASKED, 2).alias("c"))
    rows = postings.select("posting_id", F.posexplode(found).alias("pos", "m"))
    rows = rows.select("posting_id", "pos", F.col("m.n").try_cast("int").alias("years"), F.lower(F.trim("m.c")).alias("context")).where("years > 0")
    if distinct:
        first = Window.partitionBy("posting_id", "years", "context").orderBy("pos")
        rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    generic = F.col("context").isin(*GENERIC) | (F.size(F.split("context", r"\s+")) <= 2)
    return rows.withColumn("is_generic", generic)


def yoe_claims(docs: DataFrame) -> DataFrame:
    """Most years claimed in each context: doc_id, context, years."""
    text = F.lower("text")
    found = F.arrays_zip(matches(text, CLAIMED, 1).alias("n"), matches(text, CLAIMED, 2).alias("c"))
    rows = docs.select("doc_id", F.explode(found).alias("m")).select("doc_id", F.trim("m.c").alias("context"), F.col("m.n").try_cast("int").alias("years"))
    return rows.where("context <> ''").groupBy("doc_id", "context").agg(F.max("years").alias("years"))


def yoe_status(reqs: DataFrame, claims: DataFrame, docs: DataFrame, partial: float = 0.7) -> DataFrame:
    """satisfied, partial or unsatisfied for each requirement of a pair (posting_id, doc_id).

    docs: doc_id, text, span. A generic requirement is held against the span; another against the best claim whose
    context contains it or is contained, or in part against the span where the text has its first word.
    """
    asked = reqs.join(docs.select("doc_id", F.lower("text").alias("__t"), "span").hint("merge"), "doc_id")
    said = claims.select("doc_id", F.col("context").alias("__c"), F.col("years").alias("__y"))
    keys = ["posting_id", "doc_id", "pos"]
    joined = asked.drop("__t").join(said.hint("merge"), "doc_id", "left")
    meets = F.contains("context", "__c") | F.contains("__c", "context")
    best = joined.groupBy(*keys).agg(F.coalesce(F.max(F.when(meets, F.col("__y"))), F.lit(0)).alias("__best"))
    rows = asked.join(best.hint("merge"), keys)
    n, vague = F.col("years"), F.col("is_generic") | (F.col("context") == "")
    reached = F.when(vague, F.col("span")).otherwise(F.col("__best"))
    word = ~vague & F.contains("__t", F.element_at(F.split("context", r"\s+"), 1)) & (F.col("span") >= n)
    status = F.when(reached >= n, "satisfied").when((reached >= n * partial) | word, "partial").otherwise("unsatisfied")
    return rows.select(*keys, "years", "context", "is_generic", status.alias("status"))


def degree_levels(text: Column) -> Column:
    """Levels of all degree words in a text, dots inside them ignored; BE counts in capitals only."""
    words = matches(F.lower(F.replace(text, F.lit("."), F.lit(""))), "[a-z']+")
    table = F.create_map(*[F.lit(x) for pair in DEGREES for x in pair])
    bare = F.filter(F.transform(words, lambda w: F.replace(w, F.lit("'"), F.lit(""))), lambda w: w.isin([w for w, _ in DEGREES]))
    levels = F.transform(bare, lambda w: F.try_element_at(table, w))
    engineer = F.replace(text, F.lit("."), F.lit("")).rlike(r"(^|[^A-Za-z])BE([^A-Za-z]|$)")
    return F.concat(levels, F.when(engineer, F.array(F.lit(3))).otherwise(F.array().cast("array<int>")))


def degree_level(text: Column, best: bool, default: int) -> Column:
    """Highest (candidates) or lowest (postings) degree level named, or the default."""
    levels = degree_levels(F.coalesce(text, F.lit("")))
    return F.coalesce(F.array_max(levels) if best else F.array_min(levels), F.lit(default))


def facts_of(experience: Column, education: Column, as_of_year: int = 2025) -> tuple[Column, Column]:
    """Years and degree that two sections of a document tell of."""
    years = F.when(experience.isNull(), 0).otherwise(experience_span(experience, as_of_year))
    return years.alias("years"), degree_level(education, True, 3).alias("degree")


def candidate_facts(section_texts: DataFrame, as_of_year: int = 2025) -> DataFrame:
    """Years and degree of each document. section_texts: doc_id, section, text. Fewer than two years say nothing."""
    def of(section: str) -> Column:
        return F.max(F.when(F.col("section") == section, F.col("text")))

    rows = section_texts.groupBy("doc_id").agg(of("experience").alias("e"), of("education").alias("d"))
    return rows.select("doc_id", *facts_of(F.col("e"), F.col("d"), as_of_year))


def posting_requirements(texts: DataFrame) -> DataFrame:
    """Least years and degree of each posting's required text; a degree asked for is strict."""
    asked = F.filter(F.transform(matches(F.col("required_text"), ASKED, 1), lambda x: x.try_cast("int")), lambda x: x > 0)
    level = degree_level(F.col("required_text"), False, 0)
    return texts.select("posting_id", F.array_min(asked).alias("min_years"), level.alias("min_degree"), (level > 0).alias("strict_degree"), F.lit("not_specified").alias("location"))


FIELD = "struct<value:string,source_text:string,confidence:string,reasoning:string>"


def facts_from_fields(answers: DataFrame, fallback: DataFrame) -> DataFrame:
    """Years and degree from a model's raw answer, nested ({value: ...}) or flat; years are 0 at least.

    What can't be read, or a degree word not known, comes from the fallback (doc_id, years, degree); method says which.
    """
    nested = salvage_json(F.col("raw"), f"struct<years:{FIELD},degree:{FIELD}>")
    flat = salvage_json(F.col("raw"), "struct<years:string,degree:string>")
    rows = answers.select("doc_id", nested.alias("n"), flat.alias("f"))
    years = F.greatest(F.lit(0), F.coalesce(F.col("n.years.value").try_cast("int"), F.col("f.years").try_cast("int")))
    years = F.when(F.coalesce(F.col("n.years.value").try_cast("int"), F.col("f.years").try_cast("int")).isNotNull(), years)
    named = F.array_max(degree_levels(F.coalesce("n.degree.value", "f.degree", F.lit(""))))
    rows = rows.select("doc_id", years.alias("y"), named.alias("g"), F.col("n.years.confidence").alias("confidence"))
    out = fallback.join(rows, "doc_id", "left")
    method = F.when(F.col("y").isNotNull() & F.col("g").isNotNull(), "model").when(F.col("y").isNull() & F.col("g").isNull(), "fallback").otherwise("model+fallback")
    return out.select("doc_id", F.coalesce("y", "years").alias("years"), F.coalesce("g", "degree").alias("degree"), method.alias("method"), "confidence")


def _failures(rows: DataFrame, key: str, checks: list[tuple[str, Column, str, bool]]) -> DataFrame:
    found = F.array(*[F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(reason).alias("reason"), F.lit(critical).alias("critical"))) for field, bad, reason, critical in checks])
    return rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("c")).select(key, "c.*")


def check_candidate_fields(facts: DataFrame) -> DataFrame:
    """Failed checks of extracted candidate fields: doc_id, field, reason, critical.

    facts: doc_id, years, degree, title, years_source, confidence, span, gap, n_year_pairs, n_companies, text.
    """
    c = F.col
    return _failures(facts, "doc_id", [
        ("years", c("years").isNull(), "missing", True), ("degree", c("degree").isNull(), "missing", True),
        ("years", c("years") > c("span") + 1, "more than the dates span", True),
        ("years", (c("confidence") == "explicit") & (F.coalesce(F.trim("years_source"), F.lit("")) == ""), "explicit without source", True),
        ("title", c("title").isNotNull() & ~F.contains(F.lower("text"), F.lower("title")), "not verbatim", False),
        ("gap", c("gap") & F.lower("text").rlike(r"(^|[^a-z])(present|current)([^a-z]|$)"), "gap in spite of a present post", False),
        ("companies", c("n_year_pairs") > c("n_companies") + 2, "fewer companies than date ranges", False),
    ])


def check_posting_fields(reqs: DataFrame) -> DataFrame:
    """Failed checks of extracted posting fields: posting_id, field, reason, critical.

    reqs: posting_id, min_years (text), min_degree, strict_degree, text. Words are matched whole.
    """
    n, low = F.col("min_years").try_cast("int"), F.lower("text")
    either = low.rlike(r"(^|[^a-z])(bachelor|bachelors|bs|btech)([^a-z].{0,40})?[^a-z]or[^a-z](.{0,40}[^a-z])?(master|masters|ms|phd)([^a-z]|$)")
    soft = low.rlike(r"(^|[^a-z])(preferred|a plus|nice to have|ideally)([^a-z]|$)")
    return _failures(reqs, "posting_id", [
        ("min_degree", F.col("min_degree").isNull(), "missing", True), ("min_years", F.col("min_years").isNotNull() & n.isNull(), "not a number", True),
        ("min_years", n > 25, "above 25", True), ("min_years", n == 0, "zero", False),
        ("min_degree", either & (F.col("min_degree") > 3), "the lower of two degrees is enough", True),
        ("strict_degree", F.col("strict_degree") & soft, "strict although worded as a preference", False),
    ])


def merge_corrections(primary: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """Fields of fixes, where not null, over those of primary; columns that primary lacks are ignored."""
    shared = [c for c in primary.columns if c != key and c in fixes.columns]
    new = fixes.select(key, *[F.col(c).alias(f"__{c}") for c in shared])
    out = primary.join(new, key, "left")
    return out.select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in shared else F.col(c) for c in primary.columns if c != key])


def provenance(facts: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """One struct a row: method, confidence by field, failed fields."""
    failed = failures.groupBy(key).agg(F.sort_array(F.collect_set("field")).alias("failed"))
    fields = F.map_from_arrays(F.array(F.lit("years")), F.array(F.coalesce("confidence", F.lit("inferred"))))
    out = facts.join(failed.hint("merge"), key, "left")
    value = F.struct(F.col("method"), fields.alias("confidence_by_field"), F.coalesce("failed", F.array().cast("array<string>")).alias("failed"), F.col("failed").isNotNull().alias("escalated"))
    return out.select(key, value.alias("provenance"))


def override_years(facts: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """A positive whole number of years in the profile ("7" or "7+") replaces the extracted one; method is tagged."""
    stated = F.regexp_replace(F.trim("years_of_experience"), r"\++$", "").try_cast("int")
    said = profiles.select(key, stated.alias("__y")).where("__y > 0")
    out = facts.join(said, key, "left")
    method = F.when(F.col("__y").isNotNull(), F.concat("method", F.lit("+profile_override"))).otherwise(F.col("method"))
    return out.withColumn("method", method).withColumn("years", F.coalesce("__y", "years")).drop("__y")


def needs_correction(failures: DataFrame, key: str) -> DataFrame:
    """Critical failures only, a list for each record that has any."""
    bad = failures.where("critical")
    return bad.groupBy(key).agg(F.sort_array(F.collect_list(F.concat_ws(": ", "field", "reason"))).alias("reasons"))
