"""Explode, join, union and distinct over key-value frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_map(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of ``items``."""
    return df.select(*keep, F.explode(items).alias(name))


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join; repeats on either side multiply.

    The physical join is left to the planner: a side is broadcast only when its
    size is known to be small, and a skewed partition of a sort-merge join is
    split at run time.
    """
    return left.join(right, list(keys), "inner")


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)


def salted(df: DataFrame, hot: DataFrame, key: str, spread: Column) -> DataFrame:
    """Add ``salt`` to the large side of a join: rows of a hot key get 0 .. copies-1.

    ``hot`` holds ``key`` and ``copies`` for the keys above the row limit only, so
    it has at most rows / limit rows.
    """
    return df.join(hot, key, "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("copies")), F.lit(0)).cast("int")
    ).drop("copies")


def replicated(df: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """The other side of a salted join: one copy of a row per salt of its key."""
    return df.join(hot, key, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("copies"), F.lit(1)) - 1))
    ).drop("copies")


def hot_keys(df: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows and how many copies spread them evenly."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > limit)
        .select(key, F.ceil(F.col("_rows") / limit).cast("int").alias("copies"))
    )
