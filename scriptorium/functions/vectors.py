"""Vector columns as arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit(vector: Column, dimensions: int) -> Column:
    """Cut, or padded with zeros, to ``dimensions`` elements; null stays null."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), dimensions)), 1, dimensions)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def usable(vector: Column, dimensions: int) -> Column:
    """Exactly ``dimensions`` finite elements, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dimensions) & finite & F.exists(vector, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; NaN with a zero vector, as vector stores give it."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(float("nan"))).otherwise(dot(a, b) / length)


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
