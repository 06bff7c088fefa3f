"""Vector column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0.0, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 with a zero vector, an error on unequal lengths."""
    size = norm(a) * norm(b)
    value = F.when(size == 0.0, F.lit(0.0)).otherwise(dot(a, b) / size)
    return F.when(F.size(a) == F.size(b), value).otherwise(
        F.raise_error(F.lit("cosine: vectors differ in length")).cast("double")
    )
