"""Validation and application of proposed text edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmatch.functions.text import content_tokens, injected_tokens, tokens

#: Rules in the order in which they are tried.
RULES = ("unknown block", "empty text", "markup", "markdown characters", "heading block", "fabricated token", "too little kept")
RETENTION = 0.40


def rank_blocks(blocks: DataFrame, missing: DataFrame, n: int = 15) -> DataFrame:
    """The n editable blocks of each document with the most words in common with its missing terms, first ones first.

    missing: doc_id, terms (array).
    """
    words = missing.select("doc_id", F.array_distinct(tokens(F.array_join("terms", " "))).alias("__w"))
    rows = blocks.where("is_editable").join(words.hint("merge"), "doc_id")
    score = F.size(F.array_intersect(F.array_distinct(tokens(F.col("text"))), F.col("__w")))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos")
    ranked = rows.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("doc_id", "pos", "block_id", "score", "rank")


def allowed_tokens(whitelist: Column, posting_terms: Column, description: Column) -> Column:
    """What an edit may bring in: whitelist, posting terms and the posting's content tokens, in lower case."""
    def low(a: Column) -> Column:
        return F.transform(a, lambda x: F.lower(x))

    return F.array_union(F.array_union(low(whitelist), low(posting_terms)), content_tokens(description))


def _violations(declared_only: bool) -> list[Column]:
    """Conditions of RULES over old_text, block_type, known, new_text, allowed and keywords_added."""
    new, old = F.col("new_text"), F.coalesce("old_text", F.lit(""))
    brought = F.transform(F.coalesce("keywords_added", F.array().cast("array<string>")), lambda k: F.lower(k)) if declared_only else injected_tokens(old, new)
    fabricated = F.exists(brought, lambda t: ~F.exists("allowed", lambda a: F.contains(a, t)))
    had = content_tokens(old)
    kept = F.size(F.array_intersect(had, content_tokens(new)))
    return [
        ~F.col("known"), new.isNull() | (F.trim(new) == ""), new.rlike(r"(?is)<[a-z].*>"), new.rlike(r"[*_`#\[\]]"), F.col("block_type").isin("h1", "h2", "h3"),
        fabricated, (F.size(had) > 0) & (kept < F.size(had) * RETENTION),
    ]


def _with_blocks(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    texts = blocks.select("doc_id", "block_id", "block_type", F.col("text").alias("old_text"), F.lit(True).alias("known"))
    return edits.join(texts.hint("merge"), ["doc_id", "block_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def validate_edits(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """First failing rule of each edit, null where it is accepted. edits carry new_text and allowed (array)."""
    rows = _with_blocks(edits, blocks)
    rule = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in zip(RULES, _violations(False), strict=True)])
    return rows.withColumn("rule", rule)


def validate_edits_all(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """All failing rules of each edit; fabrication looks at the declared keywords only."""
    rows = _with_blocks(edits, blocks)
    found = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in zip(RULES, _violations(True), strict=True)])
    return rows.withColumn("rules", F.filter(found, lambda x: x.isNotNull()))


def apply_edits(blocks: DataFrame, accepted: DataFrame) -> DataFrame:
    """Blocks with accepted new texts; edits of unknown blocks are ignored. accepted has one row a block."""
    new = accepted.select("doc_id", "block_id", F.col("new_text").alias("__new"))
    return blocks.join(new.hint("merge"), ["doc_id", "block_id"], "left").withColumn("text", F.coalesce("__new", "text")).drop("__new")


def highlight_segments(text: Column, terms: list[str]) -> Column:
    """Text cut at any of the terms, longest first and in any case, as an array of (text, marked)."""
    pattern = "(?i)(" + "|".join(_quoted(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")"
    parts = F.split(F.regexp_replace(text, pattern, "\u0001\u0002$1\u0001"), "\u0001")
    pieces = F.transform(parts, lambda p: F.struct(F.replace(p, F.lit("\u0002"), F.lit("")).alias("text"), F.startswith(p, F.lit("\u0002")).alias("marked")))
    return F.filter(pieces, lambda p: p["text"] != "")


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


def replace_exact(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Blocks whose trimmed text equals old get new. pairs: doc_id, old, new, one row for each old text."""
    wanted = pairs.select("doc_id", F.trim("old").alias("__k"), F.col("new").alias("__new"))
    rows = blocks.withColumn("__k", F.trim("text")).join(wanted.hint("merge"), ["doc_id", "__k"], "left")
    return rows.withColumn("text", F.coalesce("__new", "text")).drop("__k", "__new")


def reject_log(validated: DataFrame) -> DataFrame:
    """Rejections by rule."""
    return validated.where("rule is not null").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
