"""Language ID by Bayesian evidence fusion: text, declared markup language, address suffix and host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmatch.llm.common import lookup_join, sampled, stored
from textmatch.llm.html import main_text

#: Hash buckets of byte trigrams, and labelled rows used to fit the text model, at most.
BUCKETS, FIT_ROWS = 1 << 14, 4_000
#: Languages of the text model at most.
LANGUAGES = 256
NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of trigram buckets by language; languages in code point order."""

    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages, float32


@dataclass(frozen=True)
class Fusion:
    """effective: trigrams that a text counts for at most, as neighbouring trigrams aren't independent.

    smooth: pseudo-counts of a declared language or suffix. host, domain: pseudo-documents by which a host's prior is
    shrunk to its domain's, and a domain's to the global one. discount: weight of declared and suffix evidence.
    """

    effective: float = 40.0
    smooth: float = 5.0
    host: float = 10.0
    domain: float = 20.0
    discount: float = 0.7


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the whole lower-cased text, runs of other than letters being one space."""
    clean = NOT_LETTERS.sub(" ", (text or "").lower())
    data = np.frombuffer(f" {clean.strip()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> TextModel:
    """Fit trigram likelihoods on at most fit_rows rows of docs (text, lang, doc_id): those with the smallest hashes.

    Counts are summed in the cluster; the driver gets BUCKETS numbers a language, for the LANGUAGES commonest of the sample.
    An id on several rows counts with each while these are within the bound; ids on few rows go first.
    """
    sample = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    ids = sample.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).distinct()

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                total = np.zeros(BUCKETS, np.int64)
                for text in texts:
                    total += np.bincount(trigrams(text), minlength=BUCKETS)
                at = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    rows = sampled(sample, ids, fit_rows).select("lang", "text")
    most = stored(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang"))
    rows = rows.join(F.broadcast(most), "lang")  # LANGUAGES rows
    summed = rows.mapInPandas(counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(summed["lang"].unique()))
    table = np.full((BUCKETS, max(1, len(languages))), 0.5)
    for i, lang in enumerate(languages):
        part = summed[summed["lang"] == lang]
        table[part["bucket"], i] += part["n"]
    return TextModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def site_columns(url: Column) -> dict[str, Column]:
    """Host, domain (its last two labels) and suffix (the last label) of an address; null where there is none."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    labels = F.split(host, r"\.")
    return {"host": host, "domain": F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."), "suffix": F.try_element_at(labels, F.lit(-1))}


def declared_language(page: Column) -> Column:
    """Primary subtag of the html element's lang, in lower case; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(page, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,8})", 1)), F.lit(""))


def fused(rows: DataFrame, model: TextModel, fusion: Fusion = Fusion(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every row: keep columns, text_lang, lang and probability.

    rows: text or html (html's main text is used where text is null), declared, suffix, domain, host, and the columns
    in keep. All may be null; a null says nothing (a null host shares one group).

    Text log-likelihoods under a flat prior give soft counts. Grouped sums of these say how often each declared
    language or suffix goes with each language, and what each host writes in, shrunk to its domain and that to the
    whole. The log of all four is added up. Only arrays of as many numbers as languages are shuffled, never texts;
    evidence tables have a row a key, and are broadcast only when counted and small.

    Defined results: null, empty or wordless text leaves the decision to the other evidence, and to the global prior
    without any; equal scores go to the first language in code point order; a model without languages gives null. Whole
    texts are read, whatever their length; repeated rows each count as evidence of their site and get equal results;
    columns to keep may have any name but those of the result.
    """
    k = len(model.languages)
    if not k:
        return rows.select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in (("text_lang", "string"), ("lang", "string"), ("probability", "double"))])
    table, effective = model.table, fusion.effective

    @F.pandas_udf("array<double>")
    def likelihood(texts: pd.Series, pages: pd.Series) -> pd.Series:
        out = []
        for text, page in zip(texts, pages, strict=True):
            at = trigrams(main_text(page) if text is None else text)
            total = table[at].sum(axis=0, dtype=np.float64) * min(1.0, effective / len(at)) if len(at) else np.zeros(k)
            out.append(np.round(total - total.max(), 6))
        return pd.Series(out)

    sites = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(c) for c in ("declared", "suffix", "domain", "host")]
    scored = stored(rows.select(*keep, *sites, likelihood("text", "html").alias("ll")))
    weights = F.transform("ll", lambda x: F.exp(x))
    soft = scored.withColumn("w", weights).withColumn("z", F.aggregate("w", F.lit(0.0), lambda s, x: s + x))
    soft = soft.select("declared", "suffix", "domain", "host", *[(F.col("w")[i] / F.col("z")).cast("decimal(12,10)").alias(f"p{i}") for i in range(k)])

    def total(frame: DataFrame, *by: str) -> DataFrame:
        return stored(frame.groupBy(*by).agg(*[F.sum(f"p{i}").cast("double").alias(f"p{i}") for i in range(k)]))

    cells = total(soft, "declared", "suffix", "domain", "host")
    world_row = cells.agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(k)]).first()
    world = np.array([world_row[i] or 0.0 for i in range(k)]) + 1.0
    prior = world / world.sum()

    def vector(parts: list[Column]) -> Column:
        return F.array(*[F.round(p, 9) for p in parts])

    def emission(by: str) -> DataFrame:
        """log P(value | language) against log P(value), damped; an absent value says nothing."""
        seen = total(cells, by)
        row_sum = sum((F.col(f"p{i}") for i in range(1, k)), F.col("p0"))
        share = (row_sum + fusion.smooth) / float(world.sum() + fusion.smooth)
        parts = [fusion.discount * F.log((F.col(f"p{i}") + fusion.smooth * share) / float(world[i] + fusion.smooth) / share) for i in range(k)]
        return stored(seen.select(by, F.when(F.col(by) == "", vector([F.lit(0.0)] * k)).otherwise(vector(parts)).alias(f"e_{by}")))

    hosts, domains = total(cells, "domain", "host"), total(cells, "domain")
    mass = sum((F.col(f"p{i}") for i in range(1, k)), F.col("p0"))
    up = domains.select("domain", *[((F.col(f"p{i}") + fusion.domain * float(prior[i])) / (mass + fusion.domain)).alias(f"d{i}") for i in range(k)])
    under = lookup_join(hosts, stored(up), ["domain"], salt="host")
    parts = [F.log((F.col(f"p{i}") + fusion.host * F.col(f"d{i}")) / (mass + fusion.host)) for i in range(k)]
    of_host = stored(under.select("domain", "host", vector(parts).alias("e_host")))

    out = lookup_join(scored, emission("declared"), ["declared"], salt="host")
    out = lookup_join(out, emission("suffix"), ["suffix"], salt="host")
    out = lookup_join(out, of_host, ["domain", "host"], salt="ll")
    score = F.array(*[F.col("ll")[i] + F.col("e_declared")[i] + F.col("e_suffix")[i] + F.col("e_host")[i] for i in range(k)])
    out = out.withColumn("score", score).withColumn("best", F.array_max("score"))
    names = F.array(*[F.lit(x) for x in model.languages])
    chance = 1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("best")))
    first = F.element_at(names, F.array_position("score", F.col("best")).cast("int"))
    by_text = F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int"))
    return out.select(*keep, by_text.alias("text_lang"), first.alias("lang"), chance.alias("probability"))
