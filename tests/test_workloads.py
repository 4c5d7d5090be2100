"""Iterative jobs against brute force and their stated properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.vectors import dot, parse_labelled, squared_distance
from millrace.operators import actions, relational
from millrace.plans import clustering, graph, regression
from tests.conftest import rows


@pytest.fixture(scope="module")
def tangled(spark):
    """A graph with cycles, self loops, repeats and one source with a third of the edges."""
    draw = random.Random(3)
    edges = [(draw.randrange(40), draw.randrange(60)) for _ in range(120)]
    edges += [(7, draw.randrange(60)) for _ in range(60)]
    return edges, spark.createDataFrame(edges + edges[:20], "src long, dst long").persist()


def ranks_by_hand(edges, rounds):
    links = {}
    for src, dst in set(edges):
        links.setdefault(src, []).append(dst)
    ranks = {node: 1.0 for node in links}
    for _ in range(rounds):
        incoming = {}
        for src, targets in links.items():
            for dst in targets if src in ranks else []:
                incoming[dst] = incoming.get(dst, 0.0) + ranks[src] / len(targets)
        ranks = {node: 0.15 + 0.85 * total for node, total in incoming.items()}
    return ranks


@pytest.mark.parametrize("rounds, hot_rows", [(1, 1_000_000), (5, 1_000_000), (5, 4)])
def test_pagerank(tangled, rounds, hot_rows):
    edges, df = tangled
    got = {r.node: r["rank"] for r in graph.pagerank(df, rounds, hot_rows).collect()}
    expected = ranks_by_hand(edges, rounds)
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[node], expected[node], rel_tol=1e-9) for node in got)
    assert min(got.values()) >= 0.15


def test_closure_with_cycles(tangled):
    edges, df = tangled
    edges = set(edges)
    reach = {a: {a} for a, _ in edges}
    expected = {}
    for start in reach:
        frontier, step, seen = {start}, 0, {}
        while frontier:
            step += 1
            frontier = {d for a, d in edges if a in frontier} - set(seen)
            seen.update({node: step for node in frontier})
        expected.update({(start, node): n for node, n in seen.items()})
    got = {(r.src, r.dst): r.hops for r in graph.closure(df).collect()}
    assert got == expected


def test_closure_of_a_long_chain_and_within_groups(spark):
    chain = [("a", i, i + 1) for i in range(30)] + [("b", 5, 6), ("b", 6, 7)]
    df = spark.createDataFrame(chain, "job string, src long, dst long")
    got = graph.closure(df, within=["job"])
    assert got.where("job = 'a'").count() == 30 * 31 // 2
    assert got.where("job = 'b'").count() == 3
    assert got.agg(F.max("hops")).first()[0] == 30


def test_roots_of_a_long_chain_give_linear_output(spark, monkeypatch):
    sizes = []
    write = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, label: sizes.append((label, (out := write(df, label)).count())) or out)
    chain = spark.range(3000).select(F.lit("a").alias("job"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    roots = spark.createDataFrame([("a", 0), ("b", 0)], "job string, root long")
    got = graph.reach(chain, roots, within=["job"])
    assert sorted((r.job, r.root, r.node) for r in got.collect()) == [*(("a", 0, k) for k in range(3001)), ("b", 0, 0)]
    assert len(sizes) < 30 and max(n for _, n in sizes) <= 3002


def test_reach_in_a_tangle_with_cycles_and_null_nodes(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(70)] + [(None, 1), (2, None), (3, 3)]
    roots = [0, 1, 2, 3, 59, 77]
    want = set()
    for root in roots:
        queue = [root]
        while queue:
            node = queue.pop()
            if (root, node) not in want:
                want.add((root, node))
                queue += [b for a, b in edges if a == node and a is not None]
    got = graph.reach(
        spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(r,) for r in roots], "root long")
    )
    assert {(r.root, r.node) for r in got.collect()} == want
    none = graph.reach(spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(5,)], "root long"))
    assert [(r.root, r.node) for r in none.collect()] == [(5, 5)]


def test_successors_of_a_hot_group(spark):
    data = [(1 if i % 3 else 2 + i, i, 10 * i) for i in range(300)]
    df = spark.createDataFrame(data, "g long, pos long, key long")
    whole = graph.successor_edges(df, "g", F.col("pos"), "key")
    pieces = graph.successor_edges(df, "g", F.col("pos"), "key", pieces=100)
    assert rows(whole) == rows(pieces)
    assert whole.count() == 199


def test_nearest_prefers_the_lower_number_and_stops_at_the_shorter_vector(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [5.0]), (3, [5.0, 1.0, 9.0])], "id long, x array<double>")
    centers = [[1.0, 0.0], [1.0, 0.0], [5.0, 1.0]]
    got = df.select("id", clustering.nearest(F.col("x"), centers).alias("n")).collect()
    assert {r.id: (r.n.center, r.n.distance) for r in got} == {1: (1, 1.0), 2: (3, 0.0), 3: (3, 0.0)}


def test_lloyd_keeps_an_empty_center_and_runs_no_round_at_converge_one(spark):
    points = spark.createDataFrame([(i, [float(i // 5 * 10), 0.0]) for i in range(10)], "id long, x array<double>")
    start = [[0.0, 1.0], [10.0, 1.0], [99.0, 99.0]]
    assert clustering.lloyd(points, 3, converge=1.0, centers=start) == start
    assert clustering.lloyd(points, 3, converge=0.0, centers=start) == [[0.0, 0.0], [10.0, 0.0], [99.0, 99.0]]


def test_lloyd_sums_up_points_in_their_tasks(spark, monkeypatch):
    """What a round shuffles is two vectors a centre and task, whatever the number of points."""
    sizes = []
    add = clustering.vector_sums
    monkeypatch.setattr(clustering, "vector_sums", lambda df, *a: sizes.append(df.count()) or add(df, *a))
    points = spark.range(0, 6000, 1, 5).select("id", F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("x"))
    got = clustering.lloyd(points, 3, converge=0.0, centers=[[0.2, 0.0], [1.1, 0.0], [2.4, 0.0]])
    assert got == [[0.0, 1.0], [1.0, 1.0], [2.0, 1.0]]
    assert sizes and max(sizes) <= 5 * 3 * 2


def test_lloyd_with_nulls_and_unequal_lengths(spark):
    data = [None, [], [0.0], [2.0, 4.0], [1.0, None], [9.0, None, 3.0], [11.0, None], [10.0, None, 5.0, 1.0]]
    points = spark.createDataFrame(list(enumerate(data)), "id long, x array<double>")
    # A null component makes all distances of its vector NaN, so the first centre is taken, as before.
    assert clustering.lloyd(points, 2, converge=0.0, max_rounds=1, centers=[[1.0, 1.0], [8.0, 9.0]]) == [[33 / 6, 4.0, 4.0, 1.0], [8.0, 9.0]]
    only = points.where("id in (4, 6)")
    assert clustering.lloyd(only, 1, converge=0.0, max_rounds=1, centers=[[3.0, 7.0]]) == [[6.0, 7.0]]


def test_squared_error(spark):
    points = spark.createDataFrame([(1, [1.0]), (2, [4.0])], "id long, x array<double>")
    assert clustering.squared_error(points, [[0.0], [5.0]]).first()[0] == 2.0


def test_first_weights_lie_in_range_and_repeat():
    weights = regression.first_weights(10)
    assert len(weights) == 10 and all(-1 <= w < 1 for w in weights)
    assert weights == regression.first_weights(10)
    assert math.isclose((weights[0] + 1) / 2, 0.7275636800328681)


def test_logistic_step_by_hand(spark):
    data = [(1.0, [1.0, 2.0]), (-1.0, [0.5, -1.0])]
    w = [0.1, -0.2]
    got = regression.logistic_weights(spark.createDataFrame(data, "y double, x array<double>"), w, 1)
    for j in range(2):
        gradient = sum(
            (1 / (1 + math.exp(-y * sum(a * b for a, b in zip(w, x)))) - 1) * y * x[j] for y, x in data
        )
        assert math.isclose(got[j], w[j] - gradient)


def test_vector_expressions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(squared_distance(F.col("a"), F.col("b"))).first()[0] == 5.0
    assert df.select(dot(F.col("a"), F.col("a"))).first()[0] == 14.0
    y, x = parse_labelled(F.lit("-1 0.5 2 7"), 2)
    assert tuple(df.select(y, x).first()) == (-1.0, [0.5, 2.0])


def test_approximate_counts_hold_their_bounds(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    got = actions.count_approx(orders, "o_orderkey", z=4.0).first()
    assert got.low <= orders.count() <= got.high
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    exact = lines.select("l_partkey").distinct().count()
    assert abs(actions.approx_distinct(lines, "l_partkey", 0.02).first()[0] - exact) <= 0.08 * exact


def test_fold_counts_its_zero_once(spark):
    df = spark.range(0, 10, numPartitions=5)
    assert actions.fold(df, F.col("id"), 100, "t").first()[0] == 145
    assert actions.fold(df.where("id < 0"), F.col("id"), 100, "t").first()[0] == 100


def test_take_sample_repeats_and_differs_by_seed(spark):
    df = spark.range(1000)
    first = rows(actions.take_sample(df, 20, "id", 42))
    assert first == rows(actions.take_sample(df.repartition(7), 20, "id", 42))
    assert len(first) == 20 and first != rows(actions.take_sample(df, 20, "id", 43))


def test_salted_join_equals_plain_join(spark):
    large = spark.range(600).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = relational.hot_keys(large, "k", 20)
    assert [r.k for r in hot.collect()] == [0]
    left, right = relational.salted(large, hot, "k", F.col("id")), relational.replicated(small, hot, "k")
    assert left.where("k = 0").select("salt").distinct().count() == 10
    got = relational.inner_join(left, right, ["k", "salt"]).drop("salt")
    assert rows(got) == rows(large.join(small, "k"))


def test_nearest_of_a_null_vector_is_null(spark):
    from millrace.plans.clustering import nearest

    df = spark.createDataFrame([(1, None), (2, [0.0, 1.0])], "id long, x array<double>")
    found = {r.id: r.n for r in df.withColumn("n", nearest(df.x, [[5.0, 5.0], [0.0, 0.0]])).collect()}
    assert (found[1].center, found[1].distance) == (None, None) and (found[2].center, found[2].distance) == (2, 1.0)


def test_draws_with_replacement(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "key string, v long")
    draws = actions.draw_with_replacement(df, 4000, "key", seed=3, parts=8)
    got = draws.collect()
    assert sorted(r.draw for r in got) == list(range(4000))
    times = [sum(r.v == v for r in got) for v in range(50)]
    assert min(times) > 40 and max(times) < 130  # 80 on average, standard deviation 9
    assert rows(draws) == rows(actions.draw_with_replacement(df, 4000, "key", seed=3, parts=8))
    assert actions.draw_with_replacement(df.limit(0), 10, "key", seed=3).count() == 0
    assert actions.draw_with_replacement(df, 0, "key", seed=3).count() == 0


def test_merged_sketches_stand_for_all_values(spark):
    df = spark.range(30000).select((F.col("id") % 6).alias("day"), (F.col("id") % 7919).alias("v"))
    days = actions.distinct_sketches(df, ["day"], "v")
    week = actions.sketched_counts(actions.merged_sketches(days, [])).first().estimate
    again = actions.sketched_counts(actions.merged_sketches(days.union(days), [])).first().estimate
    assert week == again and abs(week - 7919) < 4 * 1.04 / 64 * 7919


def test_gradient_rows_with_nulls_and_short_vectors(spark):
    data = [(1.0, [1.0, 2.0]), (-1.0, [0.5]), (None, [1.0]), (1.0, None), (-1.0, [None, 1.0]), (1.0, [3.0, 1.0, 9.0]), (1.0, [])]
    points = spark.createDataFrame(data, "y double, x array<double>").repartition(3)
    w = [0.1, -0.2]
    for _ in range(3):
        g = [0.0, 0.0]
        for y, x in [(1.0, [1.0, 2.0]), (-1.0, [0.5]), (1.0, [3.0, 1.0])]:
            pull = (1 / (1 + math.exp(-y * sum(a * b for a, b in zip(w, x, strict=False)))) - 1) * y
            for k, v in enumerate(x):
                g[k] += pull * v
        w = [a - b for a, b in zip(w, g, strict=True)]
    assert regression.logistic_weights(points, [0.1, -0.2], 3) == pytest.approx(w)
