"""Vector and probability expressions on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity with a guard against empty vectors."""
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    """Log odds after clipping to [eps, 1 - eps] (F32)."""
    q = clip(p, eps, 1 - eps)
    return F.log(q) - F.log(1.0 - q)
