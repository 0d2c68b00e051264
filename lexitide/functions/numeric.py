"""Numeric aggregates that give null where Spark's own raise on a constant column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are there; null if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
