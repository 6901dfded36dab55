"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 1024


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for null or zero vectors and for vectors of different length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(norm, F.lit(0.0)))


def fitted(v: Column, width: int = WIDTH) -> Column:
    """Padded with zeros or cut to a fixed width."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), width)), 1, width)
