"""Walks over sorted Arrow batches, group by group, and what the operators share around them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lets Spark delete a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bounds what Spark hands to Python at a time. By default that is 10,000 rows, however long their texts are.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of text that a task gets at a time.
TEXT_BYTES = 4 << 20


def saved(df: DataFrame, batch_bytes: int | None = None) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that lost executors don't cost it.

    Nothing reads the shuffle files behind it again, so they go at once. With
    ``batch_bytes`` Python gets batches of about that many bytes, or one row if it has more.
    """
    session = df.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(shared_dir(session))
    settings = {CLEAN_UP: "true"} | ({BATCH_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {name: session.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        session.conf.set(name, value)
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        for name, value in before.items():
            if value is None:
                session.conf.unset(name)
            else:
                session.conf.set(name, value)


def by_group(df: DataFrame, *key: str, least: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a key side by side: dealt and sorted by ``cell``, a 64-bit hash of the key, then by ``least``.

    Two keys that share a hash are walked as one group; the walkers allow for that.
    """
    return df.withColumn("cell", F.xxhash64(*key)).repartition("cell").sortWithinPartitions("cell", *least)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str = "cell") -> Iterator[pa.Table]:
    """Tables that hold whole groups of ``key``, from batches sorted by it. Holds a batch and a group at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch[key].to_numpy(zero_copy_only=False)
        if held and held[-1][key][-1].as_py() != values[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        last = int(np.searchsorted(values, values[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, with the end as last entry."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, int)


def fixed_binary(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """Binary values of equal length, none null, as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else column.chunk(0)
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    return np.frombuffer(data.tobytes(), kind).reshape(len(column), -1)


def to_fixed_binary(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(matrix)
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])
