"""Aggregate expressions with the sample corrections and null rules profiling needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    n = F.count(c).cast("double")
    fixed = F.skewness(c) * F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(F.count(c) >= 3, fixed)


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values or without spread."""
    n = F.count(c).cast("double")
    fixed = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(F.count(c) >= 4, fixed)
