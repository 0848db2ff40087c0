"""Scores of rare values and of outlying numbers, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def surprise(count: Column, total: Column, vocabulary: Column, alpha: float = 1.0) -> Column:
    """Bits of surprise of a value with additive smoothing."""
    return -F.log2((count + F.lit(alpha)) / (total + F.lit(alpha) * (vocabulary + 1)))


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    """|0.6745 (value - median) / mad|, 0 where the median absolute deviation is 0."""
    return F.when(mad == 0, F.lit(0.0)).otherwise(F.abs(F.lit(0.6745) * (value - median) / mad))


def ratio(part: Column, whole: Column | float) -> Column:
    """part / whole rounded to six digits, 0 for an empty whole."""
    whole = F.lit(whole) if isinstance(whole, (int, float)) else whole
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), 6)
