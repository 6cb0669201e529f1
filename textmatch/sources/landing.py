"""Landed result pages to postings, stored postings and versions, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmatch.operators.postings import dedup_batch, set_current
from textmatch.schemas import RESULT_PAGE
from textmatch.sources.commits import append_committed, read_committed


def read_raw_postings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Listings in landed result pages (JSON). A page that can't be read, or has no data, gives no rows."""
    pages = spark.read.schema(RESULT_PAGE).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return pages.select(F.explode("data").alias("r")).select("r.*")


def corrupt_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Pages that can't be read, as text."""
    pages = spark.read.schema(RESULT_PAGE).option("multiLine", multi_line).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return pages.where(F.col("_corrupt_record").isNotNull() & F.col("data").isNull()).select("_corrupt_record")


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def normalise_postings(raw: DataFrame) -> DataFrame:
    """Listings with our names and defaults; a missing part of location or salary is empty, and trimmed off at the ends.

    The key is the source's id, else company and title in lower case with underscores for blanks.
    """
    company, title = _text("employer_name", "Unknown"), _text("job_title", "Unknown")
    location = F.concat(_text("job_city"), F.lit(", "), _text("job_state"), F.lit(" "), _text("job_country"))
    salary = F.concat(_text("job_min_salary"), F.lit("-"), _text("job_max_salary"), F.lit(" "), _text("job_salary_currency"))
    made = F.replace(F.lower(F.concat(company, F.lit("_"), title)), F.lit(" "), F.lit("_"))
    return raw.select(
        company.alias("company"), title.alias("title"), _text("job_description").alias("description"), _text("job_apply_link").alias("url"),
        F.btrim(location, F.lit(", ")).alias("location"), F.btrim(salary, F.lit("- ")).alias("salary"), F.lit("Pending").alias("status"),
        F.coalesce(F.nullif("job_id", F.lit("")), made).alias("composite_key"),
    )


def append_new(df: DataFrame, path: str, key: str = "composite_key", order: tuple[str, ...] = ("company", "title"), by: str | None = None) -> DataFrame:
    """Append the rows whose key isn't stored at path, the first of each key, and return the stored table.

    Appends at the same time, from one job or several, store each key once: see append_committed(). by: a column of df
    to part the files by, such as the date of ingestion.
    """
    append_committed(dedup_batch(df, key, order), path, key, by)
    return read_committed(df.sparkSession, path, df.schema)


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def _renamed(kind: T.DataType) -> T.DataType:
    """The same type with camelCase names at every depth."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(camel(f.name), _renamed(f.dataType), f.nullable) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_renamed(kind.elementType), kind.containsNull)
    return kind


def write_report(df: DataFrame, path: str) -> DataFrame:
    """Nested rows as JSON lines with camelCase names at every depth; returns what was written, read back as text."""
    df.select(*[F.col(f.name).cast(_renamed(f.dataType)).alias(camel(f.name)) for f in df.schema]).write.json(path)
    return df.sparkSession.read.text(path)


def ingest_run_stats(raw: DataFrame, minimum: int = 75) -> DataFrame:
    """Listings fetched, passed and new for each run. raw: run_id, match_score, is_new."""
    return raw.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("match_score") >= minimum).alias("passed"), F.count_if("is_new").alias("inserted"),
        F.when(F.count_if("is_new") > 0, "new").otherwise("nothing new").alias("status"),
    )


def read_versions(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_versions(versions: DataFrame, fresh: DataFrame, path: str) -> DataFrame:
    """Versions with new ones added, the newest of each profile concerned being current; written to path."""
    newest = fresh.groupBy("profile_id").agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("version_id"))
    set_current(versions.unionByName(fresh), newest).write.parquet(path)
    return read_versions(versions.sparkSession, path, versions.schema)
