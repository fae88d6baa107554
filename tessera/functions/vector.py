"""Vectors as arrays, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for empty or null vectors, zero vectors and vectors of different lengths."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0), F.try_divide(dot(a, b), length)).otherwise(0.0)


def mean_of_top(sims: Column, k: int) -> Column:
    """The mean of the k greatest numbers of an array."""
    top = F.slice(F.sort_array(sims, asc=False), 1, k)
    return F.try_divide(F.aggregate(top, F.lit(0.0), lambda s, x: s + x), F.size(top))
