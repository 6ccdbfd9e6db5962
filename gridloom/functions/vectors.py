"""Float-array arithmetic as JVM higher-order functions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(length(a) * length(b), F.lit(0.0))


def unit(a: Column) -> Column:
    n = F.nullif(length(a), F.lit(0.0))
    return F.transform(a, lambda x: x.cast("double") / n)
