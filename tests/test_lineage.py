"""Lineage on hand-made programs, and the same answers when hot jobs are cut into blocks."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.ordered import BLOCK
from millrace.plans import advice, graph, lineage, patch, statements
from tests.conftest import rows
from tests.test_advice import program


def test_mentions_bind_to_the_newest_earlier_version(spark):
    bound = lineage.bindings(
        program(
            spark,
            (1, "write", "a", ["x"], 0),
            (2, "def", "a", ["a"], 0),
            (3, "write", "a", ["a"], 0),
            (4, "def", "b", ["a", "a", "x"], 0),
            (5, "action", "b", ["a"], 0),
        )
    )
    made = {r.node_id for r in lineage.nodes(bound).collect()}
    assert made == {1, 2, 3}
    edges = sorted((r.src, r.dst) for r in lineage.lineage_edges(bound).collect())
    assert edges == [(1, 2), (2, 3), (2, 3)]
    sinks = sorted((r.src, r.dst) for r in lineage.sink_edges(bound).collect())
    assert sinks == [(2, 4), (3, 4)]


def test_reachable_sinks_keep_repeats_and_visit_once(spark):
    inner = spark.createDataFrame([("j", 1, 2), ("j", 1, 3), ("j", 2, 4), ("j", 3, 4), ("k", 1, 2)], "job string, src long, dst long")
    sinks = spark.createDataFrame(
        [("j", 4, 9, "count", 1), ("j", 4, 9, "count", 1), ("j", 2, 8, "take", 2)],
        "job string, src long, dst long, call string, line long",
    )
    roots = lineage.fanout_candidates(inner.unionByName(sinks.select("job", "src", "dst")))
    assert {(r.job, r.node_id): r.fanout for r in roots.collect()} == {("j", 1): 2, ("j", 2): 2, ("j", 4): 2}
    got = sorted((r.root, r.sink) for r in lineage.reachable_sinks(inner, sinks, roots).collect())
    assert got == [(1, 8), (1, 9), (1, 9), (2, 8), (2, 9), (2, 9), (4, 9), (4, 9)]


def test_node_summary_text(spark):
    bound = lineage.bindings(
        program(spark, (1, "def", "a", [], 0), (2, "def", "b", ["a"], 0), (3, "action", "a", ["b"], 0), (4, "action", "a", [], 0))
    ).persist()
    made, inner, sinks = lineage.nodes(bound), lineage.lineage_edges(bound), lineage.sink_edges(bound)
    roots = lineage.fanout_candidates(inner.unionByName(sinks.select("job", "src", "dst")))
    summary = lineage.node_summary(made, inner, sinks, lineage.reachable_sinks(inner, sinks, roots))
    assert {(r.name, r.list): r["items"] for r in summary.collect()} == {
        ("a", "children"): "[b_2,0count_3,0count_4]",
        ("a", "actions"): "[count_3,count_3,count_4]",
        ("b", "children"): "[0count_3]",
        ("b", "actions"): "]",
    }


def test_version_runs_count_up_only_on_one_line(spark):
    df = program(spark, (1, "def", "a", [], 0), (2, "write", "a", [], 1), (3, "use", "b", [], 1), (4, "write", "a", [], 0), (4, "write", "a", [], 0))
    got = [(r.line, r["pass"], r.version) for r in lineage.version_runs(df).orderBy("scope", "pass", "pos").collect()]
    assert got == [(1, 1, -1), (2, 1, -1), (2, 2, 0), (4, 1, -1), (4, 1, 0)]


@pytest.fixture(scope="module")
def events(spark):
    """Events of many users, one of whom has a third of them."""
    draw = random.Random(11)
    types = sorted(statements.KIND_OF_EVENT)
    data = [
        (i, 0 if draw.random() < 0.34 else draw.randrange(1, 40), draw.choice(types), f'{{"k": {draw.randrange(100)}}}')
        for i in range(900)
    ]
    return spark.createDataFrame(data, "event_id long, user_id long, event_type string, props string").persist()


def results(events, pieces):
    trace = statements.from_events(events, pieces)
    bound = lineage.bindings(trace, pieces)
    loops = advice.loop_scopes(trace, pieces)
    kept = advice.uncovered_invariants(advice.loop_invariant_inputs(trace, loops), trace, pieces)
    state = advice.cover_state(trace)
    last = advice.last_advice_per_line(
        advice.all_advice(advice.earliest_advice(kept), advice.multi_use_datasets(trace, state), state)
    )
    lines = statements.as_lines(trace)
    return {
        "trace": trace,
        "bound": bound,
        "timeline": lineage.action_timeline(trace, pieces),
        "runs": lineage.version_runs(trace, pieces),
        "loops": loops,
        "kept": kept,
        "last": last,
        "patched": patch.patch_lines(lines, last.withColumnsRenamed({"job": "path", "line": "line_no"}), pieces),
    }


def test_hot_jobs_give_the_same_results_in_blocks(events):
    few, many = results(events, 1), results(events, 150)
    for name in few:
        expected = rows(few[name])
        assert BLOCK not in many[name].columns
        assert expected and rows(many[name]) == expected, name


def test_reachable_sinks_are_sinks_of_the_same_job(spark, events):
    bound = lineage.bindings(statements.from_events(events)).persist()
    inner, sinks = lineage.lineage_edges(bound), lineage.sink_edges(bound)
    roots = lineage.fanout_candidates(inner.unionByName(sinks.select("job", "src", "dst")))
    reached = lineage.reachable_sinks(inner, sinks, roots)
    stray = reached.join(sinks.select("job", F.col("dst").alias("sink")), ["job", "sink"], "left_anti")
    assert stray.count() == 0
    pairs = graph.closure(inner, within=["job"])
    two_steps = pairs.alias("a").join(
        pairs.alias("b"), (F.col("a.job") == F.col("b.job")) & (F.col("a.dst") == F.col("b.src"))
    ).select(F.col("a.job").alias("job"), F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
    assert two_steps.join(pairs, ["job", "src", "dst"], "left_anti").count() == 0
