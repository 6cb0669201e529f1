"""Blocks of documents: reading them from HTML, projecting, sectioning and joining them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmatch.functions.text import latest_year

#: Elements that are blocks, with the type each becomes.
BLOCK_PATTERN = r"(?is)<(h[1-3]|li|p)\b[^>]*>(.*?)(?=<(?:/?(?:h[1-6]|li|p|ul|ol|div|article|nav|footer|table)\b)|$)"


def read_blocks(pages: DataFrame) -> DataFrame:
    """Ordered typed blocks of pages (page_id, html): h1-h3, bullet or paragraph, empty ones dropped.

    is_editable: bullets and paragraphs of more than 15 characters. pos counts the blocks kept, from 0.
    """
    found = pages.select("page_id", F.regexp_extract_all("html", F.lit(BLOCK_PATTERN), 1).alias("tags"), F.regexp_extract_all("html", F.lit(BLOCK_PATTERN), 2).alias("bodies"))
    pairs = F.filter(F.transform(F.arrays_zip("tags", "bodies"), lambda b: F.struct(F.lower(b["tags"]).alias("tag"), plain(b["bodies"]).alias("text"))), lambda b: b["text"] != "")
    rows = found.select("page_id", F.posexplode(pairs).alias("pos", "b")).select("page_id", "pos", "b.tag", "b.text")
    kind = F.when(F.col("tag") == "li", "bullet").when(F.col("tag") == "p", "paragraph").otherwise(F.col("tag"))
    rows = rows.withColumn("block_type", kind).withColumn("block_id", F.concat(F.lit("b"), F.col("pos").cast("string")))
    editable = F.col("block_type").isin("bullet", "paragraph") & (F.length("text") > 15)
    return rows.select("page_id", "pos", "block_id", "block_type", "text", editable.alias("is_editable"))


def plain(body: Column) -> Column:
    """Markup taken out, the commonest entities decoded, white space squeezed."""
    text = F.regexp_replace(body, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def project_blocks(blocks: DataFrame) -> DataFrame:
    """Id, style, level and text of blocks for display."""
    return blocks.select("doc_id", F.col("block_id").alias("id"), F.col("block_type").alias("style"), F.when(F.col("block_type") == "bullet", 1).otherwise(0).alias("level"), "text")


# Words that name a section of a profile document, the longest match deciding.
SECTION_WORDS = {
    "skills": (
        "skills", "technical skills", "core competencies", "competencies", "technologies", "tech stack", "expertise", "proficiencies", "tools", "languages",
        "frameworks", "key skills",
    ),
    "summary": ("summary", "profile", "objective", "about", "overview", "professional summary", "career summary", "executive summary"),
    "experience": ("experience", "work experience", "employment", "work history", "professional experience", "career", "positions", "roles"),
    "education": ("education", "academic", "qualifications", "degrees", "university", "college", "schooling"),
    "projects": ("projects", "personal projects", "side projects", "open source", "portfolio", "work samples"),
    "certifications": ("certifications", "certificates", "credentials", "licenses", "accreditations", "awards"),
}


def heading_section(text: Column) -> Column:
    """Section named by a heading: of the longest section word it contains; null when it contains none."""
    low = F.lower(text)
    hits = [F.when(F.contains(low, F.lit(w)), F.struct(F.lit(len(w)).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s"))) for i, (s, w) in enumerate((s, w) for s, ws in SECTION_WORDS.items() for w in ws)]
    return F.greatest(*hits)["s"]


def section_blocks(blocks: DataFrame, as_of_year: int = 2025, reset_year_at_heading: bool = False) -> DataFrame:
    """Give blocks the section of the heading before them, and the last year seen so far in the document.

    A heading that names no section leaves the section as it is; before any, the section is other. Both are carried by
    a window inside the document. reset_year_at_heading forgets the year at each heading.
    """
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("block_type").isin("h1", "h2", "h3")
    rows = blocks.withColumn("__s", F.when(is_heading, heading_section(F.col("text")))).withColumn("__y", latest_year(F.col("text"), as_of_year))
    rows = rows.withColumn("section", F.coalesce(F.last("__s", True).over(order), F.lit("other")))
    if reset_year_at_heading:
        rows = rows.withColumn("__h", F.sum(is_heading.cast("int")).over(order))
        order = Window.partitionBy("doc_id", "__h").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("recency_year", F.last("__y", True).over(order))
    return rows.drop("__s", "__y", "__h")


def section_text(blocks: DataFrame) -> DataFrame:
    """Blocks of each section of a document joined by blanks, in order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return blocks.groupBy("doc_id", "section").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def section_preview(blocks: DataFrame, n: int = 3, chars: int = 120) -> DataFrame:
    """First n blocks of each section, cut for display."""
    order = Window.partitionBy("doc_id", "section").orderBy("pos")
    first = blocks.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return first.select("doc_id", "section", "place", F.substring("text", 1, chars).alias("preview"))
