"""Distances of vectors, inside Catalyst.

Vectors are arrays of float or double, or text '[x,y,...]'.  Vectors of different
lengths raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """'[x,y,...]' as an array of double; NULL where it isn't one."""
    return F.from_json(text, "array<double>")


def render(vector: Column) -> Column:
    """An array as text '[x,y,...]'."""
    return F.to_json(vector)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).when(
        a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors have different dimensions")).cast("double")
    )


def _pairs(a: Column, b: Column, f) -> Column:
    return F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance (a <-> b)."""
    return _checked(a, b, F.sqrt(_sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))))


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return _checked(a, b, _sum(_pairs(a, b, lambda x, y: x * y)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; NULL if a vector is zero."""
    square = lambda v: _sum(F.transform(v.cast("array<double>"), lambda x: x * x))
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(square(a)) * F.sqrt(square(b)))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ."""
    return _checked(a, b, _sum(_pairs(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0))))
