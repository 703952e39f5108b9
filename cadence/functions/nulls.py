"""Missing values are NULL and never NaN; these keep it so under ANSI arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: float, high: float) -> Column:
    """Between the bounds; NULL stays NULL, which greatest and least would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded for reports, without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def present(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, (c.isNotNull() for c in columns))
