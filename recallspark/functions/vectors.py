"""Vector expressions over ARRAY<FLOAT>, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column, dim: int) -> Column:
    """Right length, every component finite, not all zero."""
    low, high = F.array_min(v), F.array_max(v)
    return F.coalesce(
        (F.size(v) == dim) & (F.size(F.array_compact(v)) == dim) & (low > float("-inf")) & (high < float("inf")) & ((low != 0) | (high != 0)),
        F.lit(False),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
