"""Row-level results that a driver program asks for, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.sampling import bucket, digest
from millrace.operators.ordered import cuts_below
from millrace.session import cut


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per key, or per whole value when all columns are named."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def fold(df: DataFrame, value: Column, zero: float, name: str) -> DataFrame:
    """Sum started from ``zero``, which is counted once however many partitions there are."""
    return df.agg((F.lit(zero) + F.coalesce(F.sum(value), F.lit(0))).alias(name))


def first(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(1)


def take(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows; a total order makes the answer repeatable."""
    return df.orderBy(*order).limit(n)


def top(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def take_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run."""
    return df.orderBy(digest(seed, F.col(key)), key).limit(n)


#: Parts that rows are numbered in for draws; each is sorted by one task.
DRAW_PARTS = 65_536


def draw_with_replacement(df: DataFrame, n: int, key: str, seed: int, parts: int = DRAW_PARTS) -> DataFrame:
    """``n`` independent draws from the rows of ``df``, as ``draw`` 0 .. n-1 with the row; the same on every run.

    Rows are dealt to ``parts`` by a hash of their key, and a draw names a part, with the
    part's share of all rows, and a place in it: so how often the parts are drawn is
    multinomial, and only rows within a part are put in order. The table of parts is
    the one thing that every draw looks up. Rows that repeat a key are drawn each. No
    rows give no draws.
    """
    placed = df.withColumn("_part", bucket(seed, F.col(key), parts))
    upto = F.sum("_rows").over(Window.orderBy("_part"))
    ends = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_upto", upto)
    listed = ends.agg(F.sort_array(F.collect_list(F.struct("_upto", "_part", "_rows"))).alias("ends"))
    head = F.conv(F.substring(digest(seed, F.concat(F.lit("draw "), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    spark = df.sparkSession
    drawn = spark.range(n).select(F.col("id").alias("draw"), head.alias("_head"), listed.scalar().alias("_ends"))
    at = drawn.where(F.size("_ends") > 0).withColumn("_at", F.pmod("_head", F.element_at("_ends", -1)["_upto"]))
    # The part whose rows are numbered beyond the draw: as many ends as lie at or before it come first.
    part = F.get("_ends", cuts_below(F.transform("_ends", lambda e: e["_upto"]), F.col("_at")))
    named = at.withColumn("_one", part).select(
        "draw", F.col("_one._part").alias("_part"), (F.col("_at") - F.col("_one._upto") + F.col("_one._rows") + 1).alias("_place")
    )
    order = Window.partitionBy("_part").orderBy(digest(seed, F.col(key)), key)
    numbered = placed.join(named.select("_part").distinct(), "_part", "left_semi").withColumn("_place", F.row_number().over(order).cast("long"))
    return named.join(numbered, ["_part", "_place"]).select("draw", *df.columns)


def distinct_sketches(df: DataFrame, by: Sequence[str], column: str, precision: int = 12) -> DataFrame:
    """``by, sketch``: what is needed to count the distinct values of each group, alone or together with others.

    A sketch has 2 ** ``precision`` registers, whatever it has seen; its relative standard
    deviation is about 1.04 / sqrt(2 ** precision). Nulls are no values.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, precision).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of larger groups from those of smaller ones, without their rows."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """The number of distinct values that each sketch stands for, as ``estimate``."""
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")


def approx_distinct(df: DataFrame, column: str, error: float = 0.05) -> DataFrame:
    """Estimated number of distinct values, ``error`` being its relative standard deviation."""
    return df.agg(F.approx_count_distinct(column, error).alias("n_distinct"))


def count_approx(
    df: DataFrame,
    key: str,
    by: Sequence[str] = (),
    seed: int = 42,
    one_in: int = 8,
    z: float = 1.96,
) -> DataFrame:
    """Estimated row count from one hash bucket out of ``one_in``, with bounds.

    The sampled count is binomial, hence ``low`` and ``high`` at ``z`` standard
    deviations. Only ``key`` and ``by`` are read.
    """
    sampled = df.where(bucket(seed, F.col(key), one_in) == 0).groupBy(*by).agg(
        F.count(F.lit(1)).alias("sampled")
    )
    spread = F.lit(z) * F.sqrt(F.col("sampled") * F.lit(1 - 1 / one_in))
    return sampled.select(
        *by,
        "sampled",
        (F.col("sampled") * one_in).cast("double").alias("estimate"),
        ((F.col("sampled") - spread) * one_in).alias("low"),
        ((F.col("sampled") + spread) * one_in).alias("high"),
    )


def count_within(
    df: DataFrame,
    key: str,
    by: Sequence[str] = (),
    error: float = 0.05,
    confidence: float = 0.95,
    work: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    seed: int = 42,
    buckets: int = 64,
) -> DataFrame:
    """Estimated row counts whose bounds lie within ``error`` of them, from as few rows as that takes.

    Rows are dealt to ``buckets`` by a hash of ``key``. Rounds take 1, 2, 4, ... buckets in
    all, each only those that no earlier one had, and stop once every group's interval
    at ``confidence`` is narrow enough; with all buckets the counts are exact. ``work``,
    what is to be counted of the rows (filters, joins), runs on a round's buckets alone.
    A round leaves its counts in the shared folder, one number of it comes to the driver.

    Returns ``by, buckets_read, sampled, estimate, low, high``. Groups not met in the
    buckets read are not known of. Nothing sampled is no narrow interval, so a table
    without rows is read whole; without ``by`` it gives a row of zeros.
    """
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    place = bucket(seed, F.col(key), buckets)
    rounds, done = [], 0
    while True:
        upto = min(max(1, 2 * done), buckets)
        counted = work(df.where((place >= done) & (place < upto))).groupBy(*by).agg(F.count(F.lit(1)).alias("sampled"))
        rounds.append(cut(counted, "count"))
        done = upto
        total = reduce(DataFrame.unionByName, rounds).groupBy(*by).agg(F.sum("sampled").alias("sampled"))
        spread = F.lit(z) * F.sqrt(F.col("sampled") * F.lit(1 - done / buckets))
        if done == buckets or total.agg(F.min(spread <= error * F.col("sampled")) & (F.min("sampled") > 0)).first()[0]:
            break
    scale = buckets / done
    return total.select(
        *by,
        F.lit(done).alias("buckets_read"),
        "sampled",
        (F.col("sampled") * scale).alias("estimate"),
        ((F.col("sampled") - spread) * scale).alias("low"),
        ((F.col("sampled") + spread) * scale).alias("high"),
    )
