"""Cleaning a corpus into token ids: quality, repeated lines, near duplicates, source mix, BPE.

What every stage does with odd rows: a null text is an empty one, and whole texts are read whatever their length; rows
without doc_id are documents like others and are kept or dropped by the same rules; rows repeated with one doc_id and
text go through as often as they occur, but for the near-duplicate stage, which keeps one of them; a null source is a
source of its own; an empty table stays empty; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmatch.llm import bpe, jaccard, lines, mixing, quality
from textmatch.llm.common import stored


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being good, with their site's evidence, is at least one half."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).where("__quality >= 0.5").select(*docs.columns)  # ties at one half stay


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that ten documents or more share; every document stays, some with an empty text."""
    cleaned = lines.dedup_lines(docs)
    values = {"text": F.when(F.col("__n_dropped") == 0, F.col("text")).otherwise(F.col("__kept"))}
    return _renewed(cleaned.withColumns(values), docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near duplicates; without doc_id only where the group has none."""
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document taken twice is there twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as digests."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _renewed(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars following the text where there is such a column."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES = [("quality", keep_good), ("lines", drop_lines), ("near_duplicates", one_of_each), ("mix", mix), ("tokens", encode)]

#: SQL can't express the classifier, the MinHash join's candidates or the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
