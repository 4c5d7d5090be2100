"""Word count and access-log roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import log_parts, split_space
from millrace.operators.relational import flat_map


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """Occurrences of each space-separated, case-sensitive token."""
    return flat_map(lines, split_space(F.col(column)), "word").groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )


def log_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Key and byte count of each line.

    Lines that do not match, and those of an anonymous user, have a null key; an
    anonymous line keeps its bytes. A size of ``-`` counts as 0.
    """
    names = ("ip", "user", "query", "bytes")
    line = F.col(column)
    matched = lines.select(line.alias("_line"), log_parts(line, *names).alias("_parts")).select(
        F.when(F.col("_parts") != F.col("_line"), F.split("_parts", "\n")).alias("_parts")
    )
    fields = matched.select(*[F.get("_parts", F.lit(i)).alias(name) for i, name in enumerate(names)])
    named = F.lower("user") != "-"
    return fields.select(
        *[F.when(named, F.col(c)).alias(c) for c in ("ip", "user", "query")],
        F.coalesce(F.col("bytes").try_cast("long"), F.lit(0)).alias("bytes"),
    )


def log_rollup(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines and bytes per (ip, user, query)."""
    return log_records(lines, column).groupBy("ip", "user", "query").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")
    )


def rollup_text(rollup: DataFrame) -> DataFrame:
    return rollup.select(
        "ip", "user", "query", F.format_string("bytes=%s\tn=%s", "bytes", "n").alias("stats")
    )
