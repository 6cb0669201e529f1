"""Text rules as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern (or of one of its groups), empty for null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), group), F.array().cast("array<string>"))


def each(items: Column) -> Column:
    """A row for each item of an array that is costly to make, and one with null for an empty array, to be left out by what
    follows. With explode() Spark makes the array twice more, to filter empty ones out first."""
    return F.explode_outer(items)


def normalise_text(text: Column) -> Column:
    """Typographic quotes, dashes, blanks and ligatures to ASCII; runs of blanks to one, of newlines to two; trimmed."""
    out = F.translate(text, "‘’“”–—   ​", "''\"\"--    ")
    out = F.replace(F.replace(out, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order."""
    return matches(F.lower(text), "[a-z0-9]+")


def word_count(text: Column) -> Column:
    """White-space separated words of the trimmed text; 0 for null or blank."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def latest_year(text: Column, as_of_year: int = 2025) -> Column:
    """as_of_year where a word says the present, else the largest year from 1980 to 2029, else null."""
    now = F.lower(text).rlike(r"(^|[^a-z0-9])(present|current|now|today|ongoing)([^a-z0-9]|$)")
    return F.when(now, F.lit(as_of_year)).otherwise(F.array_max(years(text)))


def years(text: Column) -> Column:
    """Four-digit years from 1980 to 2029 that stand alone."""
    found = matches(text, r"(?<![A-Za-z0-9_])(20[0-2][0-9]|19[89][0-9])(?![A-Za-z0-9_])", 1)
    return F.transform(found, lambda y: y.cast("int"))


def experience_span(text: Column, as_of_year: int = 2025) -> Column:
    """Years from the first year mentioned to the last, or to as_of_year where a word says the present; 0 without years."""
    found = years(text)
    present = F.lower(text).rlike(r"(^|[^a-z0-9])(present|current|ongoing)([^a-z0-9]|$)")
    last = F.when(present, F.lit(as_of_year)).otherwise(F.array_max(found))
    return F.coalesce(last - F.array_min(found), F.lit(0)).cast("int")


def crude_stem(token: Column) -> Column:
    """Without the first fitting suffix of ing, tion, ed, er, es, s, if three letters or more remain."""
    out = token
    for suffix in reversed(("ing", "tion", "ed", "er", "es", "s")):
        fits = F.endswith(token, F.lit(suffix)) & (F.length(token) >= len(suffix) + 3)
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return out


def normalise_term(term: Column) -> Column:
    """Lower case, trimmed, with runs of blanks, hyphens, underscores and slashes as one blank."""
    return F.regexp_replace(F.lower(F.trim(term)), r"[\s\-_/]+", " ")


def escaped(term: Column) -> Column:
    """A term as a literal inside a regular expression."""
    return F.regexp_replace(term, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def bounded_count(text: Column, term: Column) -> Column:
    """Occurrences of a term without a letter or digit beside it, case-insensitive."""
    return F.regexp_count(F.lower(text), F.concat(F.lit("(?<![a-z0-9])"), escaped(F.lower(term)), F.lit("(?![a-z0-9])")))


# Shapes of technical tokens that are kept whole. The first six ignore case.
PROTECTED_ANY_CASE = (
    r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*(?:\s+&\s+[A-Za-z][A-Za-z0-9]*)+(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*(?:\.[A-Za-z][A-Za-z0-9]*)+(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*(?:/[A-Za-z][A-Za-z0-9]*)+(?![A-Za-z0-9_])",
    r"(?i)(?<![a-z0-9_])(?:end[-\s]to[-\s]end|full[-\s]stack|open[-\s]source)(?![a-z0-9_])",
    r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*[-\s]\d+(?:\.\d+)*(?![A-Za-z0-9_])",
)
PROTECTED_BY_CASE = (
    r"(?<![A-Za-z0-9_])[A-Z][a-z]+[A-Z][A-Za-z0-9]*(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])[A-Z]{2,4}[a-z][A-Za-z0-9]*(?![A-Za-z0-9_])",
    r"(?<![A-Za-z0-9_])[A-Z]{2,}(?:\+\+|#)?(?![A-Za-z0-9_])",
)


def protected_tokens(text: Column) -> Column:
    """Distinct technical tokens of four characters or more, in lower case."""
    found = F.flatten(F.array(*[matches(text, p) for p in (*PROTECTED_ANY_CASE, *PROTECTED_BY_CASE)]))
    return F.sort_array(F.array_distinct(F.filter(F.transform(found, lambda t: F.lower(t)), lambda t: F.length(t) >= 4)))


# Words that carry no claim of their own in an edit.
EDIT_STOP_WORDS = (
    "the", "a", "an", "and", "or", "in", "of", "to", "for", "with", "is", "are", "was", "were", "be", "been", "by", "on", "at", "as", "that", "this",
    "it", "its", "not", "but", "from", "have", "has", "had", "we", "you", "they", "their", "our", "your", "i", "my", "can", "will", "would", "could",
    "should", "may", "might", "also", "which", "who", "what", "when", "how", "if", "than", "then", "so", "up", "out", "into", "over", "after",
    "while", "using", "across", "within", "between", "through", "during", "including", "ensure", "ability", "experience", "knowledge",
    "understanding", "strong", "excellent", "good", "high", "new", "key", "well", "large", "small", "leveraging", "demonstrating", "fulfilling",
    "incorporating", "integrating", "thereby", "often", "flows", "helping", "updated", "staying", "incorporate", "ensuring", "enabling", "driving",
    "improving", "environments", "requirements", "scale", "orchestration", "agents", "various", "multiple", "complex",
)


def content_tokens(text: Column) -> Column:
    """Distinct lower-cased words of an edit (hyphens and inner dots kept) of three letters or more, without stop words."""
    found = F.transform(matches(F.lower(text), r"[a-z][a-z0-9\-.]*"), lambda t: F.regexp_replace(t, r"\.+$", ""))
    return F.array_except(F.array_distinct(F.filter(found, lambda t: F.length(t) > 2)), F.array(*[F.lit(w) for w in EDIT_STOP_WORDS]))


def injected_tokens(old: Column, new: Column) -> Column:
    """Content tokens of the new text that the old one lacks."""
    return F.array_except(content_tokens(new), content_tokens(old))


def normalise_list(value: Column) -> Column:
    """A string cut at commas and newlines into trimmed non-empty items; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"[,\n]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


CATEGORIES = "array<struct<category:string,skills:array<struct<name:string,level:int>>>>"


def _at_three(names: Column) -> Column:
    """Non-empty names as skills of level 3 in one category; an empty list of categories without any."""
    kept = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    skills = F.transform(kept, lambda x: F.struct(x.alias("name"), F.lit(3).alias("level")))
    return F.when(F.size(kept) > 0, F.array(F.struct(F.lit("Skills").alias("category"), skills.alias("skills")))).otherwise(F.array().cast(CATEGORIES))


def normalise_skills(raw: Column) -> Column:
    """Skills as JSON in one of three shapes, or as plain text, to categories of (name, level).

    Shapes: categories with skills of name and level (3 where it is missing), a list of names, a string cut at commas and
    newlines. Categories without skills are dropped; null gives an empty list.
    """
    categories = F.from_json(raw, CATEGORIES)
    named = F.filter(categories, lambda c: c["category"].isNotNull() & (F.size(c["skills"]) > 0))

    def filled(c: Column) -> Column:
        skills = F.transform(c["skills"], lambda s: F.struct(F.coalesce(s["name"], F.lit("")).alias("name"), F.coalesce(s["level"], F.lit(3)).alias("level")))
        return F.struct(c["category"].alias("category"), skills.alias("skills"))

    is_list, has_categories = F.startswith(F.trim(raw), F.lit("[")), F.size(F.filter(categories, lambda c: c["category"].isNotNull())) > 0
    plain = F.regexp_replace(raw, '^"|"$', "")
    return F.when(has_categories, F.transform(named, filled)).when(is_list, _at_three(F.from_json(raw, "array<string>"))).otherwise(_at_three(normalise_list(plain)))


def level_dots(level: Column) -> Column:
    """A level from 1 to 5 (clamped) as five dots."""
    n = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(level, F.lit(3)))).cast("int")
    return F.concat(F.call_function("repeat", F.lit("●"), n), F.call_function("repeat", F.lit("○"), 5 - n))


def contact_line(*columns: str) -> Column:
    """Non-empty contact fields joined by a bar."""
    return F.concat_ws(" | ", *[F.nullif(F.trim(c), F.lit("")) for c in columns])


def salvage_json(raw: Column, schema: T.StructType | str) -> Column:
    """Parse the outermost braces of a model's answer, code fences off; else what precedes the last comma, closed again."""
    body = F.regexp_replace(raw, r"```(?:json)?", "")
    outer = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    start = F.regexp_extract(body, r"(?s)\{.*", 0)
    cut = F.regexp_extract(start, r"(?s)^(.*),", 1)

    def parsed(text: Column, tail: str = "") -> Column:
        whole = F.concat(text, F.lit(tail))
        valid = F.get_json_object(whole, "$").isNotNull() & (whole != tail)
        return F.when(valid, F.from_json(F.when(valid, whole), schema))

    return F.coalesce(parsed(outer), parsed(cut, "}"), parsed(cut, "]}"), parsed(cut, "\"}"))
