"""Versions, lineage edges, fan-out and reachable sinks, per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.grouping import CHUNK, PIECE, value_lists
from millrace.operators.ordered import Running, row_numbers, running, with_blocks
from millrace.plans.graph import reach
from millrace.session import cut


def bindings(statements: DataFrame, pieces: int | None = None) -> DataFrame:
    """Every name a statement makes or mentions, with the version it binds to.

    ``role`` is ``version`` for the left side of a declaration or assignment,
    ``input`` for its right side, ``read`` for a plain mention, ``receiver`` and
    ``argument`` for the names in an action's call chain. ``def_pos`` is the newest
    earlier version of the name. A name is known from its first declaration on, so
    the newest earlier declaration or assignment is a version if any declaration
    came before. A statement's mentions are bound before its own version is added.
    """
    def slot(role: str, name: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), name.alias("name"))

    def slots_of(role: str) -> Column:
        return F.transform("inputs", lambda name: slot(role, name))

    name = F.col("name")
    slots = (
        F.when(F.col("kind").isin("def", "write"), F.concat(F.array(slot("version", name)), slots_of("input")))
        .when(F.col("kind") == "use", F.array(slot("read", name)))
        .when(F.col("kind") == "action", F.concat(F.array(slot("receiver", name)), slots_of("argument")))
    )
    kept = ["job", "pos", "line", "kind", "call"]
    rows = statements.select(*kept, F.explode(slots).alias("slot")).select(
        *kept, "slot.*", (F.col("slot.role") == "version").cast("int").alias("_added")
    )
    is_version = F.col("role") == "version"
    keys = ["job", "name"]
    scanned = running(
        with_blocks(rows, keys, F.col("pos"), pieces),
        keys,
        ["pos", "_added"],
        _first=Running("min", F.when(is_version & (F.col("kind") == "def"), F.col("pos"))),
        _newest=Running("max", F.when(is_version, F.col("pos"))),
    )
    return scanned.select(
        "job", "pos", "line", "kind", "call", "role", "name",
        F.when(F.col("_first").isNotNull(), F.col("_newest")).alias("def_pos"),
    )


def asof_definition(bound: DataFrame) -> DataFrame:
    """Mentions of known names with the position of the version they bind to."""
    return bound.where((F.col("role") != "version") & F.col("def_pos").isNotNull()).select(
        "job", "pos", "role", "name", "def_pos"
    )


def nodes(bound: DataFrame) -> DataFrame:
    """Declarations, and assignments to names already known."""
    known = (F.col("kind") == "def") | F.col("def_pos").isNotNull()
    return bound.where((F.col("role") == "version") & known).select(
        "job", F.col("pos").alias("node_id"), "name", "line"
    )


def lineage_edges(bound: DataFrame) -> DataFrame:
    """An edge from each bound right-hand mention to the version it helps make."""
    inputs = bound.where((F.col("role") == "input") & F.col("def_pos").isNotNull())
    made = nodes(bound).select("job", F.col("node_id").alias("pos"))
    return inputs.join(made, ["job", "pos"], "left_semi").select(
        "job", F.col("def_pos").alias("src"), F.col("pos").alias("dst")
    )


def sink_edges(bound: DataFrame) -> DataFrame:
    """An edge from each bound name in an action's call chain to the action."""
    named = bound.where(F.col("role").isin("receiver", "argument") & F.col("def_pos").isNotNull())
    return named.select(
        "job", F.col("def_pos").alias("src"), F.col("pos").alias("dst"), "call", "line"
    )


def action_timeline(statements: DataFrame, pieces: int | None = None) -> DataFrame:
    actions = statements.where(F.col("kind") == "action").select("job", "pos", "call", "line")
    return row_numbers(with_blocks(actions, ["job"], F.col("pos"), pieces), ["job"], ["pos"], "seq").select(
        "job", "seq", "call", "line"
    )


def fanout_candidates(edges: DataFrame, at_least: int = 2) -> DataFrame:
    """Versions with at least two outgoing edges, repeats counted."""
    return (
        edges.groupBy("job", F.col("src").alias("node_id"))
        .agg(F.count(F.lit(1)).alias("fanout"))
        .where(F.col("fanout") >= at_least)
    )


def reachable_sinks(inner: DataFrame, sinks: DataFrame, roots: DataFrame) -> DataFrame:
    """Sinks below each root: one row per edge into a sink from a version it reaches.

    A version counts once however many paths lead to it; two edges into the same
    sink give two rows.
    """
    starts = roots.select("job", F.col("node_id").alias("root"))
    below = reach(inner.select("job", "src", "dst"), starts, within=["job"])
    return below.withColumnRenamed("node", "src").join(sinks, ["job", "src"]).select(
        "job", "root", F.col("dst").alias("sink"), "call", "line"
    )


def repeat_expand(statements: DataFrame) -> DataFrame:
    """Each loop body twice, nested ones 2^depth times, as ``pass`` 1, 2 ..."""
    return statements.withColumn(
        "pass", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.col("depth")).cast("int")))
    )


def version_runs(statements: DataFrame, pieces: int | None = None) -> DataFrame:
    """Versions of each name in walk order with their number in a run on one line.

    A version starts at -1 and adds one for each step in which the version before
    it sits on the same line.
    """
    made = statements.where(F.col("kind").isin("def", "write")).select(
        "job", "scope", "depth", "pos", "line", "name", "kind"
    )
    keys, order = ["job", "name"], ["scope", "pass", "pos"]
    walked = with_blocks(repeat_expand(made).drop("depth"), keys, F.struct(*order), pieces)
    scanned = running(
        walked,
        keys,
        order,
        _known=Running("max", (F.col("kind") == "def").cast("int")),
        _line_before=Running("last", F.col("line")),
        _rn=Running("sum", F.lit(1).cast("long"), inclusive=True),
    ).where((F.col("kind") == "def") | (F.col("_known") == 1))
    starts = (F.coalesce(F.col("_known"), F.lit(0)) == 0) | (F.col("_line_before") != F.col("line"))
    return running(
        scanned, keys, order, _start=Running("max", F.when(starts, F.col("_rn")), inclusive=True)
    ).select(
        "job", "name", "scope", "pass", "pos", "line",
        (F.col("_rn") - F.col("_start") - 1).alias("version"),
    )


def node_summary(
    made: DataFrame, edges: DataFrame, sinks: DataFrame, reached: DataFrame, piece: int = PIECE
) -> DataFrame:
    """Text lists of each version's children and, for roots, of the sinks below.

    Items read ``name_line``; a sink's name is its call with ``0`` in front when it
    is a child. An empty list prints as ``]``. Lists come in pieces of ``piece`` items, numbered by ``chunk``.
    """
    child = edges.join(
        made.select("job", F.col("node_id").alias("dst"), "name", "line"), ["job", "dst"]
    ).select(
        "job", F.col("src").alias("node_id"), F.lit("children").alias("list"),
        F.col("dst").alias("at"), F.concat_ws("_", "name", "line").alias("item"),
    )
    sink_child = sinks.select(
        "job", F.col("src").alias("node_id"), F.lit("children").alias("list"),
        F.col("dst").alias("at"),
        F.concat(F.lit("0"), F.concat_ws("_", "call", "line")).alias("item"),
    )
    action = reached.select(
        "job", F.col("root").alias("node_id"), F.lit("actions").alias("list"),
        F.col("sink").alias("at"), F.concat_ws("_", "call", "line").alias("item"),
    )
    items = cut(child.unionByName(sink_child).unionByName(action), "items")
    lists = value_lists(items, ["job", "node_id", "list"], F.col("at"), F.col("item"), "items", piece)
    both = made.select(
        "job", "node_id", "name", "line", F.explode(F.array(F.lit("children"), F.lit("actions"))).alias("list")
    )
    body = F.concat_ws(",", "items")
    return both.join(lists, ["job", "node_id", "list"], "left").select(
        "job", "node_id", "name", "line", "list",
        F.coalesce(F.col(CHUNK), F.lit(0)).alias(CHUNK),
        F.when(F.col("items").isNull(), "]").otherwise(F.concat(F.lit("["), body, F.lit("]"))).alias("items"),
    )
