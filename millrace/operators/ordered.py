"""Ordered scans (as-of, running sums, lag) as a parallel prefix scan.

A plain window puts each group into one task. Here the rows are cut at sampled
places of the order by group and position, as a range partitioner would, into about
as many blocks as there are shuffle tasks. Each block is scanned by itself, and what
the earlier blocks of its group add up to is carried in from a table of block
totals. A group that no cut falls into is scanned whole and takes no part in the
carry. There is one plan for every table, and none of it runs before the result is
asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "block"


def with_blocks(
    df: DataFrame, keys: Sequence[str], position: Column, pieces: int | None = None
) -> DataFrame:
    """Add ``block``: null in a group without a cut, else 0, 1, 2 ... along ``position``.

    ``position`` is anything sortable that never falls along the order of the scan.
    Rows of equal position are in one block. The cuts are the ``pieces`` rows (by
    default the session's number of shuffle partitions) with the smallest hashes, a
    sample that depends on the rows alone, so every scan of the plan makes the same
    blocks. Large groups get many cuts, wherever in them the rows are; a group without
    one has about rows / pieces rows at most. The table of cuts has ``pieces`` rows at
    most, so it is broadcast. Looking for them takes no sort: each core keeps its
    ``pieces`` smallest, and one task reads those.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = (
        df.select(*keys, position.alias("_cut"))
        .coalesce(cores)
        .orderBy(F.xxhash64(*keys, "_cut"), *keys, "_cut")
        .limit(pieces)
        .groupBy(*[F.col(key).alias(f"_cut_{key}") for key in keys])
        .agg(F.sort_array(F.collect_set(F.struct("_cut"))).alias("_cuts"))
    )
    same_keys = [F.col(key).eqNullSafe(F.col(f"_cut_{key}")) for key in keys]
    placed = df.withColumn("_place", F.struct(position.alias("_cut")))
    return placed.join(F.broadcast(cuts), same_keys, "left").select(
        *[F.col(c) for c in df.columns],
        F.when(F.col("_cuts").isNotNull(), cuts_below(F.col("_cuts"), F.col("_place"))).alias(BLOCK),
    )


def cuts_below(cuts: Column, place: Column) -> Column:
    """How many of the sorted cuts are at or before ``place``, by halving the range in question."""
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))

    def halve(range_: Column, _: Column) -> Column:
        low, high = range_["low"], range_["high"]
        middle = F.shiftright(low + high, 1)
        below = F.get(cuts, middle) <= place
        return F.when(low >= high, range_).otherwise(
            F.struct(
                F.when(below, middle + 1).otherwise(low).alias("low"),
                F.when(below, high).otherwise(middle).alias("high"),
            )
        )

    whole = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))
    return F.aggregate(halvings, whole, halve, lambda range_: range_["low"])


@dataclass(frozen=True)
class Running:
    """A value over the rows before the current one, or up to it if ``inclusive``.

    ``kind`` is ``sum``, ``min``, ``max`` or ``last`` (newest value that is not null).
    """

    kind: str
    value: Column
    inclusive: bool = False


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], **values: Running
) -> DataFrame:
    """Add one running value per keyword to ``df``, as returned by ``with_blocks`` (or as one scan a group without it).

    A null key is a group like any other. The scan and the carry share one shuffle by
    keys and block; the carry has a row for each block that a cut makes.
    """
    pieces = [*keys, BLOCK] if BLOCK in df.columns else list(keys)
    scan = Window.partitionBy(*pieces).orderBy(*order)
    local = {
        name: _over_rows(run.kind, run.value).over(
            scan.rowsBetween(Window.unboundedPreceding, 0 if run.inclusive else -1)
        )
        for name, run in values.items()
    }
    if pieces == list(keys):
        return df.withColumns(
            {name: _finish(run.kind, local[name]) for name, run in values.items()}
        )
    earlier_blocks = (
        Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        df.where(F.col(BLOCK).isNotNull())
        .groupBy(*pieces)
        .agg(*[_total(run, order).alias(f"_total_{name}") for name, run in values.items()])
        .select(
            *[F.col(piece).alias(f"_carry_of_{piece}") for piece in pieces],
            *[
                _over_rows(run.kind, F.col(f"_total_{name}"))
                .over(earlier_blocks)
                .alias(f"_carry_{name}")
                for name, run in values.items()
            ],
        )
    )
    scanned = df.withColumns({f"_local_{name}": column for name, column in local.items()})
    same_piece = [scanned[piece].eqNullSafe(carry[f"_carry_of_{piece}"]) for piece in pieces]
    return scanned.join(carry, same_piece, "left").select(
        *[F.col(c) for c in df.columns],
        *[
            _finish(run.kind, _combine(run.kind, F.col(f"_local_{name}"), F.col(f"_carry_{name}"))).alias(name)
            for name, run in values.items()
        ],
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each group from 1."""
    return running(df, keys, order, **{name: Running("sum", F.lit(1).cast("long"), inclusive=True)})


def _over_rows(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value)


def _total(run: Running, order: Sequence[str]) -> Column:
    if run.kind == "last":
        when = F.when(run.value.isNotNull(), F.struct(*order))
        return F.max_by(run.value, when)
    return _over_rows(run.kind, run.value)


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "last":
        return F.coalesce(local, carry)
    return {"min": F.least, "max": F.greatest}[kind](local, carry)


def _finish(kind: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) if kind == "sum" else value
