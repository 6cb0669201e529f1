"""Declared schemas of the tables that operators pass to each other."""

from pyspark.sql import types as T

STATUSES = ("Pending", "Tailoring", "Tailored", "Applied", "Skipped")

RAW_POSTING = T.StructType([T.StructField(c, t) for c, t in (
    ("job_id", T.StringType()), ("employer_name", T.StringType()), ("job_title", T.StringType()), ("job_description", T.StringType()),
    ("job_apply_link", T.StringType()), ("job_city", T.StringType()), ("job_state", T.StringType()), ("job_country", T.StringType()),
    ("job_min_salary", T.LongType()), ("job_max_salary", T.LongType()), ("job_salary_currency", T.StringType()),
)])

RESULT_PAGE = T.StructType([T.StructField("status", T.StringType()), T.StructField("data", T.ArrayType(RAW_POSTING)), T.StructField("_corrupt_record", T.StringType())])

POSTINGS = T.StructType([T.StructField(c, t) for c, t in (
    ("posting_id", T.LongType()), ("company", T.StringType()), ("title", T.StringType()), ("description", T.StringType()), ("url", T.StringType()),
    ("location", T.StringType()), ("salary", T.StringType()), ("status", T.StringType()), ("match_score", T.IntegerType()),
    ("created_at", T.TimestampNTZType()), ("composite_key", T.StringType()),
)])
