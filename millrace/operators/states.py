"""Aggregation with the caller's own state: merged in a tree, or by class-form functions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_STATE = "id long, state binary"


def _packed(number: int, state: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"id": pa.array([number], pa.int64()), "state": pa.array([pickle.dumps(state)], pa.binary())}
    )


def aggregate(
    df: DataFrame,
    zero: Callable[[], Any],
    seq: Callable[[Any, pa.RecordBatch], Any],
    comb: Callable[[Any, Any], Any],
    finish: Callable[[Any], list[dict]],
    schema: StructType,
    depth: int = 2,
    fan: int = 32,
) -> DataFrame:
    """One state for all rows, as the rows that ``finish`` makes of it.

    ``seq`` takes an Arrow batch of rows into a state that began as ``zero()``, once per
    partition; ``comb`` merges two states, in any order and grouping, and ``zero()`` must
    change nothing there. Only states travel. Level by level they go to ``fan ** (depth
    - 1)``, then to ``fan ** (depth - 2)`` tasks, at last to one, which gets ``fan`` states
    at most; a task holds two at a time. A state must be small enough for a cell and
    can be anything that pickles. A table without rows gives ``finish(zero())``.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = zero()
        for batch in batches:
            if batch.num_rows:
                state = seq(state, batch)
        yield _packed(0, state)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, state = 0, None
        for batch in batches:
            for number, cell in zip(batch["id"].to_pylist(), batch["state"], strict=True):
                one = pickle.loads(cell.as_py())
                state = one if state is None else comb(state, one)
        if state is not None:
            yield _packed(number, state)

    shape = to_arrow_schema(schema)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch["state"].to_pylist():
                found = finish(zero() if cell is None else pickle.loads(cell))
                yield pa.RecordBatch.from_pylist(found, shape)

    states = df.mapInArrow(fold, _STATE).select(F.spark_partition_id().cast("long").alias("id"), "state")
    for level in range(depth - 1, -1, -1):
        tasks = fan**level
        dealt = states.select(F.pmod("id", F.lit(tasks)).alias("id"), "state")
        states = dealt.repartitionById(tasks, F.col("id").cast("int")).mapInArrow(merge, _STATE)
    return states.agg(F.any_value("state").alias("state")).mapInArrow(result, schema)


class TopCounts:
    """Class-form table function: the ``k`` largest different values among the rows of its partition, with their counts.

    Rows are ``(key columns, value, n)`` and count ``n`` times each, so its own results can
    be its rows again. Null values are none of them.
    """

    K = 3

    def __init__(self) -> None:
        self.key: tuple = ()
        self.counts: dict = {}

    def eval(self, row) -> None:
        self.key = row["key"]
        if row["value"] is None:
            return
        self.counts[row["value"]] = self.counts.get(row["value"], 0) + row["n"]
        if len(self.counts) > self.K:
            del self.counts[min(self.counts)]

    def terminate(self):
        for value, n in self.counts.items():
            yield self.key, value, n


def top_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, n``: the three largest different values of each key and how often they occur.

    The class runs on the rows of each key and input partition first, then on its own
    results, three a partition, so a key with most of the rows is many small groups. A
    null key is a key like others.
    """
    top = F.udtf(TopCounts, returnType="key string, value double, n long")
    rows = df.select(
        F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"), F.lit(1).cast("long").alias("n"),
        F.spark_partition_id().alias("part"),
    )
    partial = top(rows.asTable().partitionBy("key", "part"))
    return top(partial.asTable().partitionBy("key")).select(F.col("key").alias(key), F.col("value").alias(value), "n")


def geometric_means(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, mean, n``: geometric means of the positive values of each key, by grouped functions on Arrow arrays.

    A state is the sum of logarithms and a count. The rows of a key meet by input
    partition, their states by key, so no task holds more of a key than a partition
    had. Values that are null, zero or below are left out; a key with nothing else has
    a null mean and 0.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_x"), F.spark_partition_id().alias("_part"))
    state = F.arrow_udf(_log_state, "logs double, n long")
    partial = rows.groupBy("_key", "_part").agg(state("_x").alias("_state"))
    merged = partial.groupBy("_key").agg(F.sum("_state.logs").alias("_logs"), F.sum("_state.n").alias("n"))
    mean = F.when(F.col("n") > 0, F.exp(F.col("_logs") / F.col("n")))
    return merged.select(F.col("_key").alias(key), mean.alias("mean"), "n")


def _log_state(x: pa.Array) -> dict:
    kept = x.filter(pc.fill_null(pc.greater(x, 0.0), False))
    return {"logs": pc.sum(pc.ln(kept), min_count=0).as_py(), "n": len(kept)}
