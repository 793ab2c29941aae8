"""Vector arithmetic on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def blend(a: Column, b: Column, alpha: Column) -> Column:
    """``a`` moved towards ``b`` by the fraction ``alpha``."""
    return F.zip_with(a, b, lambda x, y: x * (1 - alpha) + y * alpha)


def pack(cols: list[str]) -> Column:
    """Named numeric columns as one dense vector."""
    return F.array(*[F.col(c).cast("double") for c in cols])


def array_literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
