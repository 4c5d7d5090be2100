"""Advice on what to cache: loop-invariant inputs and datasets used by several actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import Running, running, with_blocks

# The kinds of advice.
ITERATION = "Iteration"
MULTI_ACTION = "MultiAction"


def loop_scopes(statements: DataFrame, pieces: int | None = None) -> DataFrame:
    """Loops with their extent, their outermost loop's start and whether they assign.

    A scope belongs to the latest earlier scope of each lower depth, so a loop
    ends, and counts as assigning, together with the scopes inside it.
    """
    scopes = (
        statements.where(F.col("depth") > 0)
        .groupBy("job", "scope", "depth")
        .agg(
            F.min("pos").alias("start_pos"),
            F.max("pos").alias("end_pos"),
            F.max(F.col("kind").isin("def", "write")).alias("assigns"),
        )
    )
    levels = scopes.withColumn("level", F.explode(F.sequence(F.lit(1).cast("long"), F.col("depth"))))
    own = F.when(F.col("level") == F.col("depth"), F.struct("scope", "start_pos"))
    nested = running(
        with_blocks(levels, ["job", "level"], F.col("scope"), pieces),
        ["job", "level"],
        ["scope"],
        _loop=Running("last", own, inclusive=True),
    )
    extents = nested.groupBy("job", F.col("_loop.scope").alias("scope")).agg(
        F.max("end_pos").alias("end_pos"), F.max("assigns").alias("opens")
    )
    outermost = nested.where(F.col("level") == 1).select(
        "job", "scope", "depth", "start_pos", F.col("_loop.start_pos").alias("outer_start")
    )
    return outermost.join(extents, ["job", "scope"]).select(
        "job", "scope", "depth", "start_pos", "end_pos", "outer_start", "opens"
    )


def scope_reads(statements: DataFrame) -> DataFrame:
    """Right-hand mentions of declarations and assignments, and plain uses."""
    assigned = F.col("kind").isin("def", "write")
    names = F.when(assigned, F.col("inputs")).otherwise(F.array("name"))
    return statements.where(assigned | (F.col("kind") == "use")).select(
        "job", "scope", "depth", "pos", "kind", F.explode(names).alias("name")
    )


def first_in_scope(reads: DataFrame) -> DataFrame:
    """First mention of each name in each scope."""
    return reads.groupBy("job", "scope", "name").agg(
        F.min("pos").alias("pos"), F.min_by("kind", "pos").alias("kind")
    )


def outer_definitions(statements: DataFrame) -> DataFrame:
    """Names declared outside any loop, with the first and latest declaration."""
    return (
        statements.where((F.col("kind") == "def") & (F.col("depth") == 0))
        .groupBy("job", "name")
        .agg(
            F.min("pos").alias("first_decl"),
            F.max("pos").alias("decl_pos"),
            F.max_by("line", "pos").alias("decl_line"),
        )
    )


def loop_invariant_inputs(statements: DataFrame, loops: DataFrame) -> DataFrame:
    """Names a loop reads and does not write, declared before it outside any loop.

    Reads and writes fold into one row per scope and name before anything joins.
    A nested loop is judged by its own reads and writes.
    """
    def role(name: Column, read: bool) -> Column:
        return F.struct(name.alias("name"), F.lit(read).alias("read"))

    reads = F.transform("inputs", lambda name: role(name, True))
    roles = F.when(
        F.col("kind").isin("def", "write"), F.concat(F.array(role(F.col("name"), False)), reads)
    ).when(F.col("kind") == "use", F.array(role(F.col("name"), True)))
    touched = (
        statements.where(F.col("depth") > 0)
        .select("job", "scope", "pos", F.explode(roles).alias("role"))
        .groupBy("job", "scope", F.col("role.name").alias("name"))
        .agg(
            F.min(F.when(F.col("role.read"), F.col("pos"))).alias("read_pos"),
            F.max(~F.col("role.read")).alias("written"),
        )
        .where(F.col("read_pos").isNotNull() & ~F.col("written"))
    )
    return (
        touched.join(outer_definitions(statements), ["job", "name"])
        .where(F.col("first_decl") < F.col("read_pos"))
        .join(loops.where("opens").select("job", "scope", "depth", "end_pos", "outer_start"), ["job", "scope"])
        .select("job", "scope", "depth", "name", "read_pos", "end_pos", "outer_start")
    )


def cover_events(statements: DataFrame) -> DataFrame:
    """What sets a name's cover state: outer declarations and stand-alone cover calls."""
    declared = (F.col("kind") == "def") & (F.col("depth") == 0)
    return statements.where(declared | (F.col("kind") == "cover")).select(
        "job", "name", "pos", ((F.col("kind") == "cover") | F.col("covered")).alias("covered")
    )


def cover_state(statements: DataFrame) -> DataFrame:
    """Final state of each declared name: the newest cover event wins."""
    newest = cover_events(statements).groupBy("job", "name").agg(
        F.max(F.struct("pos", "covered")).alias("_newest")
    )
    return outer_definitions(statements).join(newest, ["job", "name"]).select(
        "job", "name", "decl_pos", "decl_line",
        F.col("_newest.covered").alias("covered"),
        F.when(F.col("_newest.covered"), F.col("_newest.pos")).alias("cover_pos"),
    )


def uncovered_invariants(
    invariants: DataFrame, statements: DataFrame, pieces: int | None = None
) -> DataFrame:
    """Invariants not already covered before their outermost loop.

    The state that counts is the one known where the loop ends.
    """
    probes = invariants.withColumns({"pos": F.col("end_pos"), "_probe": F.lit(1)})
    events = cover_events(statements).withColumn("_probe", F.lit(0))
    both = events.unionByName(probes, allowMissingColumns=True)
    state = F.when(F.col("_probe") == 0, F.struct("pos", "covered"))
    return (
        running(
            with_blocks(both, ["job", "name"], F.col("pos"), pieces),
            ["job", "name"],
            ["pos", "_probe"],
            _state=Running("last", state),
        )
        .where(F.col("_probe") == 1)
        .where(~(F.col("_state.covered") & (F.col("_state.pos") < F.col("outer_start"))))
        .select(*invariants.columns)
    )


def earliest_advice(uncovered: DataFrame) -> DataFrame:
    """One row per name: the earliest outermost loop, and the mention that gave it.

    Of loops nested in the same outermost one, the one that ends first gives the reason.
    """
    rank = F.struct("outer_start", "end_pos", -F.col("depth"))
    return uncovered.groupBy("job", "name").agg(
        F.min("outer_start").alias("advise_pos"), F.min_by("read_pos", rank).alias("reason_pos")
    )


def multi_use_datasets(statements: DataFrame, state: DataFrame) -> DataFrame:
    """Declared names with two or more actions, unless covered before the first one.

    The final cover position counts, so a late second cover hides an early one.
    """
    used = (
        statements.where(F.col("kind") == "action")
        .groupBy("job", "name")
        .agg(
            F.count(F.lit(1)).alias("actions"),
            F.min("pos").alias("first_pos"),
            F.min_by("line", "pos").alias("first_line"),
        )
        .where(F.col("actions") >= 2)
    )
    return (
        used.join(state, ["job", "name"])
        .where(~F.col("covered") | (F.col("cover_pos") > F.col("first_pos")))
        .select("job", "name", "actions", "first_pos", "first_line")
    )


def all_advice(earliest: DataFrame, multi: DataFrame, state: DataFrame) -> DataFrame:
    """Loop advice at the declaration's line, multi-use advice at the first action's."""
    loop = earliest.join(state, ["job", "name"]).select(
        "job", F.col("decl_line").alias("line"), F.lit(ITERATION).alias("kind"),
        F.col("advise_pos").alias("pos"), "name",
    )
    return loop.unionByName(
        multi.select(
            "job", F.col("first_line").alias("line"), F.lit(MULTI_ACTION).alias("kind"),
            F.col("first_pos").alias("pos"), "name",
        )
    )


def last_advice_per_line(advice: DataFrame) -> DataFrame:
    """One advice per line; multi-use beats loop advice, then the later one wins, then the name."""
    rank = F.when(F.col("kind") == MULTI_ACTION, 1).otherwise(0).alias("rank")
    last = F.max(F.struct(rank, "pos", "name", "kind"))
    return advice.groupBy("job", "line").agg(last.alias("_last")).select(
        "job", "line", "_last.kind", "_last.pos", "_last.name"
    )
