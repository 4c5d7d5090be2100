"""Ordered scans give the same rows whether groups are cut into blocks or not."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.grouping import value_lists
from millrace.operators.ordered import BLOCK, Running, row_numbers, running, with_blocks
from tests.conftest import rows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of the rows, gaps in the positions, nulls in the values."""
    draw = random.Random(5)
    data, position = [], 0
    for i in range(3000):
        position += draw.choice([1, 1, 1, 7, 90])
        key = "hot" if i % 3 == 0 else f"k{draw.randrange(300)}"
        data.append((key, position, draw.choice([None, draw.randrange(100)])))
    return spark.createDataFrame(data, "key string, pos long, v long").persist()


def scan(df):
    return running(
        df,
        ["key"],
        ["pos"],
        total=Running("sum", F.col("v")),
        upto=Running("sum", F.col("v"), inclusive=True),
        low=Running("min", F.col("v")),
        high=Running("max", F.col("v"), inclusive=True),
        last=Running("last", F.col("v")),
        last_inclusive=Running("last", F.col("v"), inclusive=True),
    ).drop(BLOCK)


@pytest.mark.parametrize("pieces", [1, 20, 700, 5000])
def test_blocks_do_not_change_the_scan(skewed, pieces):
    assert rows(scan(with_blocks(skewed, ["key"], F.col("pos"), pieces))) == rows(scan(skewed))


def test_blocks_are_even_where_positions_crowd(spark):
    """A third of the rows in one key, 95 % of them in a hundredth of its range, 300 cuts in all."""
    at = sorted([*range(0, 500_000, 1000), *range(250_000, 259_500)])
    data = [("hot", p) for p in at] + [(f"k{p % 4000}", p) for p in range(20_000)]
    placed = with_blocks(spark.createDataFrame(data, "key string, pos long"), ["key"], F.col("pos"), 300)
    sizes = [r["count"] for r in placed.where("key = 'hot'").groupBy(BLOCK).count().collect()]
    assert 60 < len(sizes) < 140 and max(sizes) < 1000
    assert placed.where("key <> 'hot' and block is null").count() > 18_000
    order = [r.block for r in placed.where("key = 'hot'").orderBy("pos").collect()]
    assert order == sorted(order)


def test_row_numbers_run_on_across_blocks(skewed):
    numbered = row_numbers(with_blocks(skewed, ["key"], F.col("pos"), 100), ["key"], ["pos"], "rn")
    hot = [r.rn for r in numbered.where("key = 'hot'").orderBy("pos").collect()]
    assert hot == list(range(1, 1001))


def test_blocks_along_several_columns_and_null_places(spark):
    data = [("a" if k % 3 else None, k % 7 if k % 5 else None, f"x{k % 11}" if k % 4 else None, k) for k in range(400)]
    df = spark.createDataFrame(data, "key string, day int, name string, id long")
    order = ["day", "name", "id"]
    expected = row_numbers(df, ["key"], order, "rn")
    for pieces in (3, 50, 1000):
        blocks = with_blocks(df, ["key"], F.struct(*order), pieces)
        assert rows(row_numbers(blocks, ["key"], order, "rn").drop(BLOCK)) == rows(expected)


def test_no_rows_and_one_place(spark):
    empty = spark.createDataFrame([], "key string, pos long")
    assert row_numbers(with_blocks(empty, ["key"], F.col("pos")), ["key"], ["pos"], "rn").count() == 0
    same = spark.createDataFrame([("a", 1)] * 50, "key string, pos long")
    got = row_numbers(with_blocks(same, ["key"], F.col("pos"), 20), ["key"], ["pos"], "rn")
    assert sorted(r.rn for r in got.collect()) == list(range(1, 51))


def test_value_lists_join_up_to_the_whole_list(spark):
    data = [("hot" if i % 3 else None, i, i * i) for i in range(900)] + [("cold", 1, 5), ("cold", 2, None), ("none", 1, None)]
    df = spark.createDataFrame(data, "key string, pos long, v long")
    for cuts in (1, 40):
        pieces = value_lists(df, ["key"], F.col("pos"), F.col("v"), "vs", piece=100, cuts=cuts).collect()
        assert {(p.key, p.chunk): len(p.vs) for p in pieces} == {
            **{("hot", k): 100 for k in range(6)}, **{(None, k): 100 for k in range(3)}, ("cold", 0): 1, ("none", 0): 0
        }
        joined = {}
        for piece in sorted(pieces, key=lambda p: p.chunk):
            joined.setdefault(piece.key, []).extend(piece.vs)
        assert joined["hot"] == [i * i for i in range(900) if i % 3]
        assert joined[None] == [i * i for i in range(900) if i % 3 == 0]
        assert joined["cold"] == [5]


def test_value_lists_take_a_number_of_tasks(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    lists = value_lists(df, ["k"], F.col("id"), F.col("id"), "ids", partitions=3)
    assert lists.rdd.getNumPartitions() == 3
    assert {r.k: len(r.ids) for r in lists.collect()} == {k: len(range(k, 100, 7)) for k in range(7)}


def test_null_key_is_a_group_with_and_without_blocks(spark):
    df = spark.createDataFrame([(None if k % 2 else "a", k) for k in range(40)], "k string, at long")
    plain = row_numbers(df, ["k"], ["at"], "n")
    blocks = row_numbers(with_blocks(df, ["k"], F.col("at"), pieces=30), ["k"], ["at"], "n")
    assert rows(blocks.select("k", "at", "n")) == rows(plain)
