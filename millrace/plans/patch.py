"""Putting advice into program text, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.program import program_marks
from millrace.functions.text import matching_tokens
from millrace.operators.ordered import Running, running, with_blocks
from millrace.plans.advice import ITERATION, MULTI_ACTION

# Fixed value: the call that covers a dataset.
COVER = ".cache()"


def patch_lines(lines: DataFrame, advice: DataFrame, pieces: int | None = None) -> DataFrame:
    """``lines(path, line_no, text)`` with ``advice(path, line_no, kind, name)`` applied.

    Loop advice goes before the first ``;`` of its line. Multi-use advice becomes a
    line of its own before, with the same indent. Lines are numbered anew. A line
    with loop advice and no ``;`` stays as it is and is flagged.
    """
    advised = with_blocks(lines, ["path"], F.col("line_no"), pieces).join(
        advice.select("path", "line_no", "kind", "name"), ["path", "line_no"], "left"
    )
    loop = F.col("kind").eqNullSafe(F.lit(ITERATION))
    extra = F.col("kind").eqNullSafe(F.lit(MULTI_ACTION))
    at = F.instr("text", ";")
    suffixed = F.concat(
        F.substring("text", F.lit(1), at - 1), F.lit(COVER), F.substring("text", at, F.length("text"))
    )
    inserted = F.concat(F.regexp_extract("text", "^[\t ]*", 0), F.col("name"), F.lit(f"{COVER};"))
    pieces = (
        F.when(extra, F.array(inserted, "text"))
        .when(loop & (at > 0), F.array(suffixed))
        .otherwise(F.array("text"))
    )
    placed = running(
        advised,
        ["path"],
        ["line_no"],
        _added=Running("sum", extra.cast("long")),
    )
    return placed.select(
        "path", "line_no", "_added", (loop & (at == 0)).alias("unpatched"), F.posexplode(pieces).alias("_i", "text")
    ).select("path", (F.col("line_no") + F.col("_added") + F.col("_i")).alias("line_no"), "text", "unpatched")


def mentions(lines: DataFrame, what: str, pattern: str, separator: str = r"\s+") -> DataFrame:
    """One row per token of a line that matches ``pattern`` as a whole."""
    return lines.select(
        "path", "line_no", F.lit(what).alias("what"),
        F.explode(matching_tokens(F.col("text"), pattern, separator)).alias("token"),
    )


def program_mentions(lines: DataFrame) -> DataFrame:
    """``path, line_no, what, token, root``: dataset types, and action and cover calls with the root of their chain."""
    return lines.select("path", "line_no", F.explode(program_marks(F.col("text"))).alias("found")).select(
        "path", "line_no", "found.*"
    )


def actions_per_root(lines: DataFrame) -> DataFrame:
    """``path, root, actions``: how many actions the call chains of each leftmost name end or pass."""
    calls = program_mentions(lines).where((F.col("what") == "action") & F.col("root").isNotNull())
    return calls.groupBy("path", "root").agg(F.count(F.lit(1)).alias("actions"))
