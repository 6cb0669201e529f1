"""Vector products as column functions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is null or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def fit_score(similarity: Column, low: float = 0.15, high: float = 0.70) -> Column:
    """Similarity between low and high as 0 to 100, rounded half up and clamped; null stays null."""
    scaled = ((similarity - low) / (high - low) * 100).cast("decimal(18,6)")
    return F.when(scaled.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.round(scaled, 0).cast("int"))))
