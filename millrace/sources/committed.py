"""A sink for effects of the caller's own that counts every task once, also when a task runs twice.

Each task writes what the caller makes of its rows to a file of its own and reports its
name. Only when all tasks have ended well does the driver write a manifest of the
files reported; readers read what the manifest names. What a failed or doubled attempt
has left is in no manifest, and an aborted write deletes what was reported.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "millrace_committed"
MANIFEST = "_manifest.json"


@dataclass
class Part(WriterCommitMessage):
    name: str
    lines: int


class LineWriter(DataSourceWriter):
    """Writes the string column ``value`` as lines."""

    def __init__(self, path: str):
        self.path = path

    def _place(self, name: str):
        system, root = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return system, f"{root.rstrip('/')}/{name}"

    def write(self, rows: Iterator[Row]) -> Part:
        name, lines = f"part-{uuid.uuid4().hex}", 0
        system, path = self._place(name)
        system.create_dir(path.rpartition("/")[0])
        with system.open_output_stream(path) as out:
            for row in rows:
                out.write(row.value.encode() + b"\n")
                lines += 1
        return Part(name, lines)

    def commit(self, messages: list[Part | None]) -> None:
        system, path = self._place(MANIFEST)
        parts = [{"name": m.name, "lines": m.lines} for m in messages if m is not None]
        system.create_dir(path.rpartition("/")[0])
        with system.open_output_stream(path + ".new") as out:
            out.write(json.dumps(parts).encode())
        system.move(path + ".new", path)  # readers see a whole manifest or none

    def abort(self, messages: list[Part | None]) -> None:
        for message in messages:
            if message is not None:
                system, path = self._place(message.name)
                system.delete_file(path)


class CommittedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"])


def save_lines(df: DataFrame, path: str) -> None:
    """Write the one string column ``value`` of ``df``, none of it null, as lines that are all there or not at all."""
    df.sparkSession.dataSource.register(CommittedLines)
    df.select("value").write.format(NAME).mode("append").option("path", path).save()


def saved_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that a committed write has left, as ``value``. Without a commit there are none."""
    system, place = LineWriter(path)._place(MANIFEST)
    if system.get_file_info(place).type == fs.FileType.NotFound:
        return spark.createDataFrame([], "value string")
    with system.open_input_stream(place) as manifest:
        parts = json.loads(manifest.read())
    names = [f"{path}/{part['name']}" for part in parts if part["lines"]]
    return spark.read.text(names) if names else spark.createDataFrame([], "value string")


def results_of_partitions(df: DataFrame, effect: Callable[[Iterator[Row]], Iterable[str]], path: str) -> DataFrame:
    """Run ``effect`` once over the rows of each partition and keep the lines it returns; a task's lines count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (Row(**r) for batch in batches for r in batch.to_pylist())
        yield pa.record_batch({"value": pa.array([str(line) for line in effect(rows)], pa.string())})

    save_lines(df.mapInArrow(run, "value string"), path)
    return saved_lines(df.sparkSession, path)


def results_of_rows(df: DataFrame, effect: Callable[[Row], str], path: str) -> DataFrame:
    """Run ``effect`` once for each row and keep the line it returns."""
    return results_of_partitions(df, lambda rows: map(effect, rows), path)
