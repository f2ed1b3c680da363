"""Arrays of numbers as vectors, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, of another length, or zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def letter_counts(texts: list[str]) -> list[list[float]]:
    """How often a text has each of the letters a to z: a vector where no model is at hand."""
    return [[float(low.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for low in map(str.lower, texts)]
