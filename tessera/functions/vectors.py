"""Vector expressions on array<float> columns; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalise(a: Column) -> Column:
    """A zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Null if the sizes differ, 0 if either is a zero vector."""
    product = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(product == 0, 0.0).otherwise(dot(a, b) / product))


def similarity(metric: str, distance: Column) -> Column:
    """cosine: 1 - d within 0 and 1; l2: 1/(1+d); ip: -d within 0 and 1."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return {"cosine": unit(1 - distance), "l2": 1 / (1 + distance), "ip": unit(-distance)}[metric]
