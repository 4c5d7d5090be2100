"""Session settings and the shared folder that loop state is written to."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session may do without the setting: there the driver is
    the only machine, so a temporary folder is shared by definition.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    return _local_fallback()


@functools.cache
def _local_fallback() -> str:
    return tempfile.mkdtemp(prefix="millrace-")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    The plan starts afresh at the table, which outlives any executor and tells
    the planner its true size.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, label: str, *key: str, buckets: int | None = None, into: str | None = None) -> str:
    """Store ``df`` in the shared folder as a table dealt by ``key``, and name it.

    Tables dealt by keys of the same kind into as many buckets (by default the session's
    number of shuffle partitions) join without a shuffle. With ``into`` the rows are
    added to that table. ``forget`` it when nothing reads it any more.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = into or f"millrace_{label}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *key).write.mode("append" if into else "errorifexists")
    if not into:
        writer = writer.option("path", f"{shared_dir(spark)}/millrace/{name}")
    writer.format("parquet").bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    return name


def location(spark: SparkSession, name: str) -> str:
    """Where a table of ``stored_by`` lies."""
    return f"{shared_dir(spark)}/millrace/{name}"


def forget(spark: SparkSession, name: str, keep_files: bool = False) -> None:
    """Take a table of ``stored_by`` out of the catalog and, if wanted, its files out of the shared folder."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if not keep_files:
        remove(spark, location(spark, name))


def remove(spark: SparkSession, path: str) -> None:
    """Delete what ``cut`` or ``stored_by`` wrote there."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
