"""Vector expressions on array columns, in doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("double")


def _known(b: Column | Sequence[float]) -> Column:
    return b if isinstance(b, Column) else F.array(*(F.lit(float(x)) for x in b))


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    """Inner product, summed from the left; b: a column or a known vector."""
    return F.aggregate(F.zip_with(a, _known(b), lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + _d(x) * _d(x)))


def cosine(a: Column, b: Column | Sequence[float]) -> Column:
    """Cosine similarity; 0.0 where a norm is zero."""
    length = norm(b) if isinstance(b, Column) else F.lit(sum(float(x) * float(x) for x in b) ** 0.5)
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * length), F.lit(0.0))
