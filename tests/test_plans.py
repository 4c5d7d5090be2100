"""Physical plans keep the shape that lets them grow."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import grouping
from millrace.operators.ordered import Running, running, with_blocks
from millrace.plans import graph
from millrace.queries import QUERIES
from millrace.session import CHECKPOINT_DIR, shared_dir


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["first_row", "take_n", "take_ordered", "top_n", "take_sample"])
def test_limits_never_sort_the_whole_table(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


@pytest.mark.parametrize(
    "name, shuffles",
    [
        ("map_project", 0), ("key_value", 0), ("flat_map_words", 0), ("flat_map_pairs", 0), ("split_space", 0),
        ("parse_vector", 0), ("log_fields", 0), ("union_all", 0), ("swap_edges", 0),
        ("word_count", 1), ("log_rollup", 1), ("reduce_by_key", 1), ("count_by_value", 1), ("distinct_pairs", 1),
        ("vector_mean", 1), ("out_degree", 2),
        ("patch_lines", 5),  # both sides of the join and the blocks, written twice and run once, and the carry
    ],
)
def test_shuffles(spark, sf_dir, name, shuffles):
    assert plan_of(QUERIES[name](spark, sf_dir)).count("Exchange hashpartitioning") <= shuffles


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_crosses_or_sorts_globally(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize(
    "name, columns",
    [("reduce_by_key", "l_partkey:bigint,l_quantity:double"), ("count_by_key", "o_custkey:bigint"),
     ("group_key_count", "l_partkey:bigint"), ("values_only", "l_quantity:double")],
)
def test_scans_read_only_what_they_use(spark, sf_dir, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan_of(QUERIES[name](spark, sf_dir))


def test_scan_and_carry_share_one_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    scanned = running(with_blocks(rows, ["k"], F.col("id")), ["k"], ["id"], n=Running("sum", F.lit(1)))
    plan = plan_of(scanned)
    assert plan.count("Window") == 2 and "TakeOrderedAndProject" in plan
    assert "Exchange hashpartitioning(k" in plan and "Exchange" not in plan[: plan.index("Window")]
    assert "rangepartitioning" not in plan


def test_scans_start_no_job_before_they_are_read(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    spark.sparkContext.setJobGroup("scan", "scan")
    lists = grouping.value_lists(rows, ["k"], F.col("id"), F.col("id"), "ids")
    scanned = running(with_blocks(rows, ["k"], F.col("id")), ["k"], ["id"], n=Running("sum", F.lit(1)))
    started = spark.sparkContext.statusTracker().getJobIdsForGroup("scan")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not list(started) and scanned.columns and lists.columns


@pytest.fixture
def recorded(spark, monkeypatch):
    """Plans of what the graph loops write, by label, with no table small enough to be broadcast."""
    plans = defaultdict(list)
    for name in ("cut", "stored_by"):
        write = getattr(graph, name)

        def record(df, label, *rest, write=write, **named):
            plans[label].append(plan_of(df))
            return write(df, label, *rest, **named)

        monkeypatch.setattr(graph, name, record)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    yield plans
    spark.conf.set(threshold, before)


def test_pagerank_rounds_shuffle_neither_links_nor_ranks(spark, recorded):
    pairs = spark.range(500).select((F.col("id") % 50).alias("src"), (F.col("id") % 37).alias("dst"))
    graph.pagerank(pairs, 2, links_per_salt=5)
    assert len(recorded["ranks"]) == 3
    for plan in recorded["ranks"][1:]:
        assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange") == 1
        assert plan.index("Exchange") < plan.index("SortMergeJoin")


def test_closure_rounds_shuffle_new_pairs_only(spark, recorded):
    edges = spark.range(40).select(F.lit(1).alias("job"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    pairs = graph.closure(edges, within=["job"])
    assert pairs.count() == 40 * 41 // 2
    assert len(recorded["paths"]) == 7
    for plan in recorded["paths"][1:]:
        known = plan[plan.rindex("FileScan") :]
        assert "Bucketed: true" in known or "millrace_known" in known
        # One shuffle deals the heads to the tails, one the new pairs to the known ones.
        assert plan.count("Exchange hashpartitioning") == 2


def test_loops_leave_only_their_result(spark, tmp_path, monkeypatch):
    from millrace import session

    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    edges = spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.closure(edges).count() == 20 * 21 // 2
    assert [p.name.split("_")[1] for p in (tmp_path / "millrace").iterdir()] == ["known"]
    graph.pagerank(edges, 3)
    left = sorted(p.name.split("_")[1] for p in (tmp_path / "millrace").iterdir())
    assert left == ["known", "ranks"]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("millrace_")]


def test_shared_dir_comes_from_the_session(spark):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, values):
            self.conf = Conf(**values)

    assert shared_dir(Session({CHECKPOINT_DIR: "hdfs://x/y/"})) == "hdfs://x/y"
    assert shared_dir(spark) == shared_dir(spark)
    with pytest.raises(ValueError):
        shared_dir(Session({"spark.master": "yarn"}))
