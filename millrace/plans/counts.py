"""Key count after grouping, and the share of rows that meet a condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_count(df: DataFrame, key: str) -> DataFrame:
    """Number of groups. Only keys are shuffled, never the grouped values."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).agg(F.count(F.lit(1)).alias("n"))


def indicator_ratio(df: DataFrame, condition: Column, scale: float) -> DataFrame:
    """``scale`` times the share of rows that meet ``condition``."""
    met = F.sum(F.when(condition, 1).otherwise(0))
    return df.agg((F.lit(scale) * met / F.count(F.lit(1))).alias("ratio"))
