"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, zero or not finite."""
    size = norm(a) * norm(b)
    good = a.isNotNull() & b.isNotNull() & (size > 0) & ~F.isnan(size) & (size < float("inf"))
    return F.when(good, dot(a, b) / size).otherwise(0.0)


def normalized(a: Column) -> Column:
    """Unchanged where the norm is 0 or not finite."""
    n = norm(a)
    return F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
