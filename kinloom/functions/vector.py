"""Vectors as array columns; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def unit(a: Column, least: float = 1e-10) -> Column:
    """A vector shorter than `least` stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n < least, 1.0).otherwise(n))


def unit_distance(a: Column, b: Column) -> Column:
    """Cosine distance of unit vectors."""
    return 1 - dot(a, b)


def cosine_distance(a: Column, b: Column, least: float = 1e-9) -> Column:
    return 1 - dot(a, b) / (F.greatest(norm(a), F.lit(least)) * F.greatest(norm(b), F.lit(least)))


def cosine_distance_or_null(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def guarded(a: Column, size: int) -> Column:
    """A vector of another length counts as zeros."""
    return F.when(F.size(a) == size, a.cast("array<float>")).otherwise(F.array_repeat(F.lit(0.0).cast("float"), size))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
