"""Aggregates that give NULL where the built-in ones divide by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r of the pairs without a null; NULL if either side is constant."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = a.isNotNull() & b.isNotNull()
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b)))
