"""Vector functions on arrays of floats as Column expressions; elements are doubles before anything is summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio.functions.text import col


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a, b) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine likeness; 0 for a null vector, as each norm is taken 1e-12 longer."""
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def squared_l2(a, b) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def memory_bytes(n, dimensions, bytes_each) -> Column:
    return col(n).cast("double") * col(dimensions) * col(bytes_each)
