"""Vector functions (Column -> Column) over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is. The norm is repeated beside the places: within the lambda it would
    be evaluated for each of them."""
    n = norm(a)
    return F.when(n > 0, F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, m: x / m)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """0 when one of the vectors is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def equal_share(a: Column, b: Column, n: int) -> Column:
    """Share of n places at which two arrays agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(n))
