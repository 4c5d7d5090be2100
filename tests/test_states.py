"""States of the caller's own, class-form functions, and counts to a confidence."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import actions, states

SPREAD = StructType().add("n", "long").add("mean", "double").add("m2", "double").add("most", "long")


def _moments(state, batch):
    for x in batch.column(0).drop_null().to_pylist():
        n, mean, m2, most = state
        step = x - mean
        mean += step / (n + 1)
        state = (n + 1, mean, m2 + step * (x - mean), most)
    return state


def _merged(a, b):
    """Moments of both; ``most`` is the largest number of states that one task merged at a level, by its own count."""
    n = a[0] + b[0]
    step = b[1] - a[1]
    mean = a[1] + step * b[0] / n if n else 0.0
    return n, mean, a[2] + b[2] + (step * step * a[0] * b[0] / n if n else 0.0), a[3] + 1


def _row(state):
    return [dict(zip(SPREAD.names, state, strict=True))]


@pytest.mark.parametrize("depth, fan", [(1, 2), (2, 4), (3, 3)])
def test_aggregate_in_a_tree(spark, depth, fan):
    df = spark.range(0, 1000, 1, 40).select(F.when(F.col("id") % 10 != 3, F.col("id").cast("double")).alias("x"))
    got = states.aggregate(df, lambda: (0, 0.0, 0.0, 0), _moments, _merged, _row, SPREAD, depth, fan).first()
    xs = [x for x in range(1000) if x % 10 != 3]
    mean = sum(xs) / len(xs)
    assert got.n == len(xs) and math.isclose(got["mean"], mean)
    assert math.isclose(got.m2, sum((x - mean) ** 2 for x in xs))
    if depth > 1:
        assert got.most < 39  # a chain of merges of one task and those before it, not of all 40 states


def test_aggregate_of_no_rows_is_the_zero(spark):
    df = spark.range(0).select(F.col("id").cast("double").alias("x"))
    got = states.aggregate(df, lambda: (0, 0.0, 0.0, 0), _moments, _merged, _row, SPREAD).collect()
    assert [tuple(r) for r in got] == [(0, 0.0, 0.0, 0)]


def test_class_functions_by_key(spark):
    values = [(k, float(x % 7) if x % 5 else None) for x in range(200) for k in ("a", "a", None)] + [("b", None)]
    df = spark.createDataFrame(values, "k string, x double").repartition(6)
    got = {(r.k, r.x): r.n for r in states.top_counts(df, "k", "x").collect()}
    counts = Counter(v for v in values if v[1] is not None and v[1] >= 4)
    assert got == dict(counts)
    means = {r.k: (r["mean"], r.n) for r in states.geometric_means(df, "k", "x").collect()}
    for k in ("a", None):
        xs = [x for key, x in values if key == k and x]
        assert means[k][1] == len(xs) and math.isclose(means[k][0], math.exp(sum(map(math.log, xs)) / len(xs)))
    assert means["b"] == (None, 0)


def test_class_functions_of_no_rows(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert states.top_counts(df, "k", "x").collect() == states.geometric_means(df, "k", "x").collect() == []


def test_count_within_stops_early_and_covers(spark):
    rows = spark.range(20_000)
    met = 0
    for seed in range(20):
        got = actions.count_within(rows, "id", error=0.1, confidence=0.9, seed=seed, work=lambda r: r.where("id % 2 = 0")).first()
        assert got.buckets_read < 64 and got.estimate - got.low <= 0.1 * got.estimate
        met += got.low <= 10_000 <= got.high
    assert met >= 14  # 90 % of 20 are expected; fewer than 14 has a chance below 0.3 %


def test_count_within_of_few_rows_is_exact(spark):
    rows = spark.range(30).select("id", (F.col("id") % 3).alias("k"))
    got = {r.k: (r.buckets_read, r.sampled, r.low, r.high) for r in actions.count_within(rows, "id", ["k"]).collect()}
    assert got == {k: (64, 10, 10.0, 10.0) for k in range(3)}
    assert [r.estimate for r in actions.count_within(rows.limit(0), "id").collect()] == [0.0]
    assert actions.count_within(rows.limit(0), "id", ["k"]).collect() == []
