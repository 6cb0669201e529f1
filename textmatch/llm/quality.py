"""Quality classifier with hierarchical empirical Bayes site priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmatch.llm.common import lookup_join, sampled, stored

#: Labelled documents used to fit the document classifier, at most: those with the smallest hashes of doc_id.
FIT_ROWS = 4_000
#: Hash buckets of byte n-grams (of one to three bytes), and the ratios that stand beside them.
BUCKETS, RATIOS = 1 << 12, 6


@dataclass(frozen=True)
class Model:
    """A fitted logistic regression on hashed n-grams and standardised ratios; prior is the share of good labels in its sample."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # BUCKETS + RATIOS, float32
    bias: float
    prior: float


def features(text: str | None) -> np.ndarray:
    """What a whole text is written like: square roots of its byte n-gram counts, hashed and scaled to length one, and ratios.

    A short text's n-grams count for less, in proportion to the root of its length up to 400 bytes, so that it says little
    by itself. The ratios: logarithm of words, distinct words, words like the one before, distinct lines, words a line,
    characters a word. Null counts as empty.
    """
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    grams = np.zeros(BUCKETS, np.float64)
    for n in (1, 2, 3):
        if len(data) >= n:
            code = data[: len(data) - n + 1]
            for k in range(1, n):
                code = code * np.uint32(257) + data[k : len(data) - n + 1 + k]
            grams += np.bincount(((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=BUCKETS)
    grams = np.sqrt(grams / max(grams.sum(), 1.0)) * min(1.0, (len(data) / 400) ** 0.5)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ratios = [np.log1p(len(words)), len(set(words)) / n, again / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)), len(text) / n]
    return np.concatenate([grams, ratios]).astype(np.float32)


def _standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows of features with their ratios as deviations from the sample's, small enough to stand beside n-grams."""
    out = x.copy()
    out[:, BUCKETS:] = np.clip((x[:, BUCKETS:] - mean) / scale, -5, 5) * 0.3
    return out


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights and bias of a logistic regression, by gradient descent with momentum."""
    mean, scale = x[:, BUCKETS:].mean(axis=0), x[:, BUCKETS:].std(axis=0) + np.float32(1e-6)
    z = _standardised(x, mean, scale)
    w, speed, b = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32), 0.0
    for _ in range(steps):
        off = (1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30))) - y).astype(np.float32)
        speed = 0.9 * speed + z.T @ off / np.float32(len(y)) + np.float32(ridge) * w
        w -= np.float32(4) * speed
        b -= 4 * float(off.mean())
    return mean, scale, w, b


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, ridge: float = 1e-4, steps: int = 300) -> Model:
    """Fit the document classifier on at most fit_rows labelled documents (labels: doc_id, quality 0 or 1).

    The sample's ids are at most fit_rows rows, so they are broadcast. Features, as many numbers a row whatever its length,
    are made where the texts are and meet in one task, which fit_rows bounds too; the driver gets the weights only. With
    no usable labels, or labels of one kind, the model says its prior everywhere. Of equal hashes the smaller doc_id
    comes first; a doc_id labelled twice counts as good if either label does, and one with several texts counts with each,
    if these are within the bound; ids on few rows go first.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def featured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "x": [features(t).tobytes() for t in frame["text"]]})

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "y": [], "x": []}), *frames]).sort_values(["doc_id", "x"])
        y = rows["y"].to_numpy(np.float32)
        if len(np.unique(y)) < 2:
            prior = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
            mean, scale, w, b = np.zeros(RATIOS), np.ones(RATIOS), np.zeros(BUCKETS + RATIOS), float(np.log(prior / (1 - prior)))
        else:
            prior = float(y.mean())
            mean, scale, w, b = _fitted(np.frombuffer(b"".join(rows["x"]), np.float32).reshape(len(rows), -1), y, ridge, steps)
        yield pd.DataFrame({"mean": [mean.tolist()], "scale": [scale.tolist()], "weights": [w.tolist()], "bias": [b], "prior": [prior]})

    rows = sampled(docs.select("doc_id", "text"), sample, fit_rows).mapInPandas(featured, "doc_id long, y int, x binary")
    model = rows.repartition(1).mapInPandas(fitted, "mean array<double>, scale array<double>, weights array<double>, bias double, prior double").first()
    mean, scale, weights = (np.array(model[c], np.float32) for c in ("mean", "scale", "weights"))
    return Model(mean, scale, weights, model["bias"], model["prior"])


def _own_probability(model: Model):
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            x = np.stack([features(t) for t in texts.iloc[at : at + 256]])
            out[at : at + 256] = (_standardised(x, model.mean, model.scale) * model.weights).sum(axis=1, dtype=np.float64) + model.bias
        return pd.Series(np.round(1 / (1 + np.exp(-np.clip(out, -12, 12))), 9))

    return run


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(sums: DataFrame, rate: str, least: float = 2.0, most: float = 1000.0) -> Column:
    """Pseudo-documents of a Beta prior over groups (n, s), by the method of moments: less spread, more shrinking."""
    weight, mean = F.sum("n"), F.sum("s") / F.sum("n")
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(rate), 2)) / weight
    noise = mean * (1 - mean) * F.count(F.lit(1)) / weight
    between = F.greatest(spread - noise, F.lit(1e-6))
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(mean * (1 - mean) / between - 1, F.lit(most))))


def scored(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add __doc (the document's own probability of being good) and __quality (with its site's evidence).

    docs: doc_id, text, and the columns named by host and path (for web pages, host name and first path segment; here
    the source and its language section). All documents, not only labelled ones, count towards their site. keep: columns
    to return, all by default. Texts are read once: what is kept is stored with __doc, and site counts come from there.

    Soft counts of good documents are summed by (host, path), then by host, then over everything. A host's rate is
    shrunk to the global rate, a path's to its host's, each by a strength estimated from how much groups differ beyond
    chance, so that a sparse site says what its parent says. The document's own soft count is left out of its site's.
    The final odds are the document's odds times path odds over the classifier's prior odds.

    Defined results: null text is scored as empty; null host or path is a site of its own; repeated rows count as often
    as they occur and score alike, as do equal texts of one site; an empty table gives an empty table. Working columns
    start with two underscores, so other columns can have any name.
    """
    kept = list(keep or docs.columns)
    site = {"__host": F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")), "__path": F.coalesce(F.concat(F.lit("p"), F.col(path)), F.lit(""))}
    own = _own_probability(model)(F.col("text")).alias("__doc")
    evidence = stored(docs.withColumns(site).select(*kept, "__host", "__path", F.xxhash64("doc_id", "text").alias("__salt"), own))

    paths = stored(evidence.groupBy("__host", "__path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("__doc").cast("decimal(20,9)")).cast("double").alias("s")))
    hosts = stored(paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    world = hosts.agg((F.sum("s") / F.sum("n")).alias("rate"))
    over = hosts.crossJoin(F.broadcast(world))  # one row
    over = over.crossJoin(F.broadcast(over.agg(_strength(over, "rate").alias("k"))))  # one row
    over = stored(over.select("__host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + F.col("k") * F.col("rate")) / (F.col("n") + F.col("k"))).alias("host_rate"), "rate"))
    under = stored(lookup_join(paths, over, ["__host"]))
    strength = stored(under.agg(_strength(under, "host_rate").alias("path_k")))
    sites = stored(under.crossJoin(F.broadcast(strength)).select("__host", "__path", *[F.col(c).alias(f"__{c}") for c in ("n", "s", "host_rate", "path_k")]))  # one row

    out = lookup_join(evidence, sites, ["__host", "__path"], salt="__salt")
    path_rate = (F.col("__s") - F.col("__doc") + F.col("__path_k") * F.col("__host_rate")) / (F.col("__n") - 1 + F.col("__path_k"))
    safe = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), path_rate))
    prior = min(max(model.prior, 1e-4), 1 - 1e-4)
    quality = _expit(_logit(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("__doc")))) + _logit(safe) - F.lit(float(np.log(prior / (1 - prior)))))
    return out.select(*kept, "__doc", path_rate.alias("__site"), quality.alias("__quality"))
