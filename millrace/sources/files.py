"""Text, columnar and model files, literal rows, and per-partition side effects."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """One row per line. Without ``separator`` all usual line ends count."""
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    return reader.text(path)


def write_lines(df: DataFrame, path: str, separator: str = "\n") -> None:
    """Write a frame of one string column as text."""
    df.write.option("lineSep", separator).text(path)


def read_columns(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read a columnar file, skipping schema discovery when the schema is known."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def write_columns(df: DataFrame, path: str) -> None:
    """The binary sink: typed, splittable and compressed."""
    df.write.parquet(path)


def literal_rows(
    spark: SparkSession, rows: Iterable[tuple], schema: str, partitions: int | None = None
) -> DataFrame:
    """A table from values in the driver program, spread over ``partitions``."""
    df = spark.createDataFrame(list(rows), schema)
    return df.repartition(partitions) if partitions else df


def save_model(model: KMeansModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> KMeansModel:
    return KMeansModel.load(path)


def for_each_partition(df: DataFrame, effect: Callable[[Iterator[Row]], None]) -> None:
    """Run ``effect`` once per partition, over its rows."""
    df.foreachPartition(effect)


def for_each_row(df: DataFrame, effect: Callable[[Row], None]) -> None:
    """Run ``effect`` once per row."""
    df.foreach(effect)


def for_each_batch(df: DataFrame, effect: Callable[[pa.RecordBatch], None]) -> None:
    """Run ``effect`` over Arrow batches: the side effect without a Python object per row.

    Accumulators that ``effect`` adds to count each partition once, also when a
    task has to run again, because the batches are consumed by the final stage.
    """

    def consume(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            effect(batch)
        yield from ()

    df.mapInArrow(consume, "done boolean").select(F.col("done")).write.format("noop").mode(
        "overwrite"
    ).save()
