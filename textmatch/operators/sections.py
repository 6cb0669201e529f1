"""Posting texts to titled sections and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmatch.functions.text import normalise_text, tokens

# Phrases that name a section of a posting. A paragraph scores the words of those it contains.
SECTION_KEYS = {
    "required": (
        "required", "requirements", "must have", "must-have", "essential", "minimum qualification", "minimum qualifications", "minimum requirement",
        "minimum requirements", "basic qualification", "basic qualifications", "qualifications", "qualification", "mandatory skills", "required skills",
        "you must", "what you'll need", "what you need", "key requirements", "core requirements",
    ),
    "preferred": (
        "preferred", "nice to have", "nice-to-have", "bonus", "additional skills", "good to have", "ideally", "desired", "is a plus", "will be a plus",
        "would be a plus", "preferred qualifications", "preferred skills", "familiarity",
    ),
    "responsibilities": (
        "key responsibilities", "responsibilities", "what you'll do", "what you will do", "you will", "duties", "day to day", "your role",
        "roles and responsibilities", "job responsibilities", "what we expect",
    ),
    "about": ("about us", "about the company", "who we are", "our mission", "about the role", "company overview"),
}
# The same for the older form, which knows a title section.
OLDER_SECTION_KEYS = {
    "title": (
        "senior", "engineer", "developer", "scientist", "analyst", "manager", "lead", "architect", "we are looking for", "we're looking for", "about the role",
        "job title", "position",
    ),
    "required": (
        "required", "requirements", "must have", "must-have", "essential", "minimum qualifications", "basic qualifications", "you must", "what you'll need",
        "what you need",
    ),
    "preferred": ("preferred", "nice to have", "nice-to-have", "bonus", "plus", "additional skills", "good to have", "ideally", "desired"),
    "responsibilities": ("responsibilities", "what you'll do", "you will", "duties", "day to day", "your role"),
    "about": ("about us", "about the company", "who we are", "our mission"),
}
# Starts of the lines that open a listing's footer.
FOOTER_STARTS = (
    "role:", "industry type:", "industry:", "department:", "employment type:", "role category:", "job category:", "education", "ug:", "pg:", "key skills",
    "skills highlighted", "about company", "company profile", "perks and benefits", "salary:", "ctc:", "notice period:",
)
# Words of job titles, and phrases that are not titles.
TITLE_WORDS = (
    "engineer", "developer", "scientist", "analyst", "manager", "lead", "architect", "designer", "specialist", "director", "researcher", "consultant", "intern",
    "associate",
)
NOT_TITLES = ("software development", "software product", "engineering - ", "full time", "permanent", "any graduate", "software & qa")
# Words that coverage doesn't ask for.
COVERAGE_STOP_WORDS = (
    "the", "a", "an", "and", "or", "in", "of", "to", "for", "with", "is", "are", "be", "as", "at", "by", "on", "not", "that", "this", "we", "you", "will", "your",
    "our", "etc", "e", "g", "eg",
)


def _any_contained(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def strip_footer(text: Column) -> Column:
    """Drop everything from the first short line that opens a footer, unless less than a fifth of the text would stay."""
    lines = F.split(text, "\n")
    starts = F.array(*[F.lit(w) for w in FOOTER_STARTS])

    def opens(line: Column) -> Column:
        low = F.lower(F.trim(line))
        return (F.length(low) < 60) & F.exists(starts, lambda w: F.startswith(low, w))

    flags = F.transform(lines, opens)
    at = F.array_position(flags, F.lit(True))
    rest = F.trim(F.array_join(F.slice(lines, F.lit(1), (at - 1).cast("int")), "\n"))
    return F.when((at > 0) & (F.length(rest) >= F.length(text) * 0.2), rest).when(at > 0, text).otherwise(F.trim(text))


def section_of(paragraph: Column, keys: dict[str, tuple[str, ...]] = SECTION_KEYS) -> Column:
    """Section with the most words in the phrases the paragraph contains; earlier sections win ties, none gives general."""
    low = F.lower(paragraph)
    scores = []
    for i, (name, phrases) in enumerate(keys.items()):
        score = sum((F.when(F.contains(low, F.lit(p)), len(p.split())).otherwise(0) for p in phrases[1:]), F.when(F.contains(low, F.lit(phrases[0])), len(phrases[0].split())).otherwise(0))
        scores.append(F.struct(score.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def detect_sections(postings: DataFrame, keys: dict[str, tuple[str, ...]] = SECTION_KEYS) -> DataFrame:
    """Paragraphs (posting_id, pos, section, paragraph) of description, split at blank lines."""
    rows = postings.select("posting_id", F.posexplode(F.split("description", r"\n{2,}")).alias("pos", "paragraph"))
    return rows.withColumn("section", section_of(F.col("paragraph"), keys))


def extract_title(text: Column, older: bool = False) -> Column:
    """A labelled title of 4 to 79 characters, else the first short line with a title word; '' if there is none.

    older: no phrase is ruled out, only the first nine title words count, and the first line, cut at 80, is better than none.
    """
    labels = (r"(?i)(?:role|position|job title)\s*[:\-]\s*(.+)", r"(?i)we(?:'re| are) (?:looking|hiring) for an?\s+(.+?)(?:\s+to|\s+who|\.|$)")

    def allowed(line: Column) -> Column:
        return F.lit(True) if older else ~_any_contained(F.lower(line), NOT_TITLES)

    def accepted(label: str) -> Column:
        found = F.trim(F.regexp_extract(text, label, 1))
        return F.when((F.length(found) > 3) & (F.length(found) < 80) & allowed(found), found)

    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    words = TITLE_WORDS[:9] if older else TITLE_WORDS
    titled = F.filter(lines, lambda x: (F.length(x) > 0) & (F.length(x) < 100) & _any_contained(F.lower(x), words) & allowed(x))
    first = F.substring(F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1)), 1, 80) if older else F.lit("")
    return F.coalesce(*[accepted(label) for label in labels], F.try_element_at(titled, F.lit(1)), first, F.lit(""))


def section_lines(sections: DataFrame) -> DataFrame:
    """Trimmed non-empty lines of each section, one leading bullet mark taken off, in order: posting_id, section, pos, line."""
    lines = sections.select("posting_id", "section", "pos", F.posexplode(F.split("paragraph", "\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace(F.trim("line"), r"^[-•*·▪▸►‣⁃]\s*", ""))).where("line <> ''")
    order = Window.partitionBy("posting_id", "section").orderBy("pos", "at")
    return lines.select("posting_id", "section", (F.row_number().over(order) - 1).alias("pos"), "line")


def structure_postings(postings: DataFrame) -> DataFrame:
    """Title, lines by section and method of every posting: normalise, cut the footer, find sections, split lines."""
    clean = postings.select("posting_id", strip_footer(normalise_text(F.col("description"))).alias("description"))
    lines = section_lines(detect_sections(clean))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    by_section = lines.groupBy("posting_id", "section").agg(ordered.alias("lines"))
    wide = by_section.groupBy("posting_id").pivot("section", [*SECTION_KEYS, "general"]).agg(F.first("lines"))
    empty = F.array().cast("array<string>")
    titled = clean.select("posting_id", extract_title(F.col("description")).alias("title"))
    out = titled.join(wide.hint("merge"), "posting_id", "left").withColumnRenamed("general", "other")
    return out.select("posting_id", "title", *[F.coalesce(c, empty).alias(c) for c in (*SECTION_KEYS, "other")], F.lit("fallback").alias("method"))


def token_coverage(text: Column, structured: Column) -> Column:
    """Share of the distinct content tokens of a text that its structured form has; 1 when there are none."""
    wanted = F.array_except(F.array_distinct(tokens(text)), F.array(*[F.lit(w) for w in COVERAGE_STOP_WORDS]))
    n = F.size(wanted)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(wanted, tokens(structured))) / n)


SECTION_FIELDS = ("responsibilities", "required", "preferred", "about", "other")
MODEL_SCHEMA = "title string, " + ", ".join(f"{c} array<string>" for c in SECTION_FIELDS)


def validate_sections(answers: DataFrame) -> DataFrame:
    """Parsed model answers with all six keys: lists inside lists unfolded, items trimmed, blank ones dropped.

    parsed is a struct of MODEL_SCHEMA; a list inside a list is read as its text, which is parsed here.
    """
    whole = F.col("parsed").isNotNull() & F.col("parsed.title").isNotNull()
    for c in SECTION_FIELDS:
        whole = whole & F.col(f"parsed.{c}").isNotNull()

    def unfolded(x: Column) -> Column:
        return F.when(F.startswith(F.trim(x), F.lit("[")), F.coalesce(F.from_json(x, "array<string>"), F.array(x))).otherwise(F.array(x))

    def cleaned(c: str) -> Column:
        items = F.flatten(F.transform(f"parsed.{c}", unfolded))
        return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")).alias(c)

    return answers.where(whole).select("posting_id", F.trim("parsed.title").alias("title"), *[cleaned(c) for c in SECTION_FIELDS])


def choose_structure(postings: DataFrame, primary: DataFrame, secondary: DataFrame, rules: DataFrame, threshold: float = 0.85) -> DataFrame:
    """First of two models' valid answers that covers its posting, else the rules' result; method says which.

    primary and secondary come from validate_sections, rules from structure_postings.
    """
    fields = ("title", *SECTION_FIELDS)
    texts = postings.select("posting_id", "description")

    def covering(answers: DataFrame, name: str) -> DataFrame:
        said = F.concat_ws(" ", "title", *SECTION_FIELDS)
        good = answers.join(texts, "posting_id").where(token_coverage(F.col("description"), said) >= threshold)
        return good.select("posting_id", F.struct(*fields).alias(name))

    out = rules.join(covering(primary, "p").hint("merge"), "posting_id", "left").join(covering(secondary, "s").hint("merge"), "posting_id", "left")
    chosen = F.coalesce("p", "s", F.struct(*fields))
    method = F.when(F.col("p").isNotNull(), "llm").when(F.col("s").isNotNull(), "llm-secondary").otherwise("fallback")
    return out.select("posting_id", *[chosen[c].alias(c) for c in fields], method.alias("method"))
