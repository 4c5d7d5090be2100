"""The statement table that the lineage jobs work on.

``statements(job, pos, line, kind, name, inputs, call, covered, scope, depth)``:
one row per statement of many driver programs. ``pos`` is unique within a job and
rises along the program; ``scope`` numbers stretches of statements at one loop
``depth`` (0 is outside any loop). Kinds are ``def`` (declaration), ``write``
(assignment), ``use`` (mention in an expression), ``action`` and ``cover``.
``inputs`` are the names on the right-hand side, or in the arguments of an
action's call chain, repeats kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import row_numbers, with_blocks
from millrace.session import cut

# Fixed values of the trace read out of an event table.
KIND_OF_EVENT = {
    "view": "def", "click": "use", "purchase": "action", "error": "cover", "signup": "write",
}
CALLS = ("collect", "count", "first", "reduce", "take")
NAMES = 5
SCOPE_ROWS = 8
SCOPE_DEPTHS = 3
LINE_ROWS = 2


def from_events(events: DataFrame, pieces: int | None = None) -> DataFrame:
    """Read each user's events as the statements of one job."""
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long")
    kind = F.create_map(*[F.lit(x) for pair in KIND_OF_EVENT.items() for x in pair])
    rows = events.select(
        F.col("user_id").alias("job"),
        F.col("event_id").alias("pos"),
        F.try_element_at(kind, F.col("event_type")).alias("kind"),
        k.alias("k"),
    )
    numbered = row_numbers(with_blocks(rows, ["job"], F.col("pos"), pieces), ["job"], ["pos"], "rn")
    earlier = F.col("rn") - 1
    scope = F.floor(earlier / SCOPE_ROWS)
    return cut(
        numbered.select(
            "job",
            "pos",
            (F.floor(earlier / LINE_ROWS) + 1).alias("line"),
            "kind",
            _dataset(F.col("k")).alias("name"),
            _inputs(F.col("kind"), F.col("k")).alias("inputs"),
            F.when(
                F.col("kind") == "action", F.get(F.array(*map(F.lit, CALLS)), (F.col("k") % len(CALLS)).cast("int"))
            ).alias("call"),
            ((F.col("kind") == "def") & (F.col("k") % 7 == 0)).alias("covered"),
            scope.alias("scope"),
            (scope % SCOPE_DEPTHS).alias("depth"),
        ),
        "statements",
    )


def _dataset(k: Column) -> Column:
    return F.concat(F.lit("d"), (k % NAMES).cast("string"))


def _inputs(kind: Column, k: Column) -> Column:
    """One other name; sometimes two, the same one twice, or the assigned name itself."""
    after = _dataset(k + 1)
    return (
        F.when((kind == "write") & (k % 4 == 0), F.array(_dataset(k)))
        .when(k % 3 == 0, F.array(after, _dataset(k + 2)))
        .when(k % 11 == 0, F.array(after, after))
        .otherwise(F.array(after))
    )


def as_lines(statements: DataFrame) -> DataFrame:
    """Program text ``lines(path, line_no, text)``, indented by loop depth."""
    names = F.array_join("inputs", ", ")
    made = F.concat(F.col("name"), F.lit(" = map("), names, F.lit(")"))
    text = (
        F.when(
            F.col("kind") == "def",
            F.concat(F.lit("JavaRDD "), made, F.when(F.col("covered"), ".persist();").otherwise(";")),
        )
        .when(F.col("kind") == "write", F.concat(made, F.lit(";")))
        .when(F.col("kind") == "use", F.concat(F.lit("show("), F.col("name"), F.lit(");")))
        .when(
            F.col("kind") == "action",
            F.concat(F.col("name"), F.lit(".union("), names, F.lit(")."), F.col("call"), F.lit("();")),
        )
        .otherwise(F.concat(F.col("name"), F.lit(".cache();")))
    )
    return (
        statements.groupBy(F.col("job").alias("path"), F.col("line").alias("line_no"))
        .agg(
            F.min("depth").alias("depth"),
            F.sort_array(F.collect_list(F.struct("pos", text.alias("text")))).alias("parts"),
        )
        .select(
            "path",
            "line_no",
            F.concat(F.repeat(F.lit("\t"), F.col("depth").cast("int")), F.concat_ws(" ", "parts.text")).alias("text"),
        )
    )
