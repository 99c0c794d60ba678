"""Vector functions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    den = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(den > 0, dot(x, y) / den).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
