"""Grouping: value lists in bounded pieces, vector sums, two-level totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import row_numbers, with_blocks

CHUNK = "chunk"
#: Values of one list; a larger group comes as several.
PIECE = 10_000


def value_lists(
    df: DataFrame,
    keys: Sequence[str],
    position: Column,
    value: Column,
    name: str,
    piece: int = PIECE,
    partitions: int | None = None,
    cuts: int | None = None,
) -> DataFrame:
    """All values of each key, ordered by ``position`` and then by value, in lists of ``piece`` values.

    Row number r of a group, from 1, is in the list with ``chunk`` floor((r - 1) / piece);
    lists joined in order of chunk are the whole, so no task ever holds more than a
    piece of it. Null values are left out of their list. ``partitions`` sets how many
    tasks do the grouping, ``cuts`` into how many blocks the numbering is cut.
    """
    rows = df.select(*keys, position.alias("_at"), value.alias("_value"))
    numbered = row_numbers(with_blocks(rows, keys, F.col("_at"), cuts), keys, ["_at", "_value"], "_number")
    pieces = numbered.withColumn(CHUNK, F.floor((F.col("_number") - 1) / piece))
    if partitions:
        pieces = pieces.repartition(partitions, *keys, CHUNK)
    return (
        pieces.groupBy(*keys, CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct("_number", "_value"))).alias("_pairs"))
        .select(*keys, CHUNK, F.filter(F.col("_pairs._value"), lambda v: v.isNotNull()).alias(name))
    )


def partition_lists(df: DataFrame, key: str, partition: Column, partitions: int, piece: int = PIECE) -> DataFrame:
    """Keys held by each of ``partitions`` partitions, in key order, in lists of ``piece``, numbered from 0."""
    index_in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (
        df.select(F.col(key), partition.cast("int").alias("partition"))
        .repartitionById(partitions, F.col("partition"))
        .sortWithinPartitions("partition", key)
        .withColumn(CHUNK, F.floor(index_in_partition / piece))
        .groupBy("partition", CHUNK)
        .agg(F.sort_array(F.collect_list(key)).alias("keys"))
    )


def two_level(
    df: DataFrame, spread: Sequence[str], buckets: int, first: Sequence[Column], second: Sequence[Column]
) -> DataFrame:
    """Aggregate into ``buckets`` partial rows by a hash of ``spread``, then into one."""
    partial = df.groupBy(F.pmod(F.xxhash64(*spread), F.lit(buckets)).alias("_bucket")).agg(*first)
    return partial.agg(*second)


def vector_sums(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Element-wise sum and count of the vectors of each key: one row per key and dimension.

    The exploded elements fold into the map-side hash table at once, so what is
    shuffled is keys x dimensions per task, not the elements.
    """
    return (
        df.select(*keys, F.posexplode(vector).alias("dim", "_x"))
        .groupBy(*keys, "dim")
        .agg(F.sum("_x").alias("total"), F.count("_x").alias("n"))
    )


def vector_means(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    return vector_sums(df, keys, vector).withColumn("mean", F.col("total") / F.col("n"))
