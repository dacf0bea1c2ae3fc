"""Vector functions in double precision, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0 or the lengths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """The vector divided by its norm, so that a dot product is a cosine; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, 0.0).otherwise(x.cast("double") / n))
