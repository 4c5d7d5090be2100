"""Actions as queries."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import actions, grouping, states
from millrace.queries.registry import query, table
from millrace.session import cut

BUCKET = "CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) % 8 = 0"
BOUNDS = """n AS sampled, CAST(n * 8 AS DOUBLE) AS estimate,
    round((n - 1.96 * sqrt(n * 0.875)) * 8, 6) AS low, round((n + 1.96 * sqrt(n * 0.875)) * 8, 6) AS high"""


@query(
    "agg_global",
    """SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(min(l_discount), 2) AS low,
           round(max(l_discount), 2) AS high FROM lineitem""",
)
def agg_global(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.min("l_discount"), 2).alias("low"), F.round(F.max("l_discount"), 2).alias("high"),
    )


@query(
    "agg_two_level",
    """SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity, max(l_extendedprice) AS high FROM lineitem""",
)
def agg_two_level(spark, sf_dir):
    return grouping.two_level(
        table(spark, sf_dir, "lineitem"), ["l_orderkey"], 64,
        [F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.max("l_extendedprice").alias("h")],
        [F.sum("n").alias("n"), F.round(F.sum("q"), 2).alias("quantity"), F.max("h").alias("high")],
    )


@query("count_rows", "SELECT count(*) AS n FROM lineitem")
def count_rows(spark, sf_dir):
    return actions.count_rows(table(spark, sf_dir, "lineitem"))


@query("count_sampled", f"SELECT {BOUNDS} FROM (SELECT count(*) AS n FROM orders WHERE {BUCKET})")
def count_sampled(spark, sf_dir):
    return _rounded(actions.count_approx(table(spark, sf_dir, "orders"), "o_orderkey"))


@query(
    "approx_distinct",
    "SELECT count(DISTINCT l_partkey) AS n_distinct, true AS close FROM lineitem",
)
def approx_distinct(spark, sf_dir):
    """The exact number, and whether the estimate lies within three standard deviations of it."""
    both = table(spark, sf_dir, "lineitem").agg(
        F.count_distinct("l_partkey").alias("n_distinct"), F.approx_count_distinct("l_partkey", 0.05).alias("estimate")
    )
    close = F.abs(F.col("estimate") - F.col("n_distinct")) <= 3 * 0.05 * F.col("n_distinct")
    return both.select("n_distinct", close.alias("close"))


@query("count_by_key", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def count_by_key(spark, sf_dir):
    return actions.count_by(table(spark, sf_dir, "orders"), "o_custkey")


@query(
    "count_by_value",
    """SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem
       GROUP BY l_returnflag, l_linestatus, l_quantity""",
)
def count_by_value(spark, sf_dir):
    return actions.count_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")


@query(
    "count_by_value_sampled",
    f"""SELECT o_orderpriority, {BOUNDS} FROM (
        SELECT o_orderpriority, count(*) AS n FROM orders WHERE {BUCKET} GROUP BY o_orderpriority)""",
)
def count_by_value_sampled(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return _rounded(actions.count_approx(orders, "o_orderkey", by=["o_orderpriority"]))


@query("first_row", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1")
def first_row(spark, sf_dir):
    return actions.first(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("fold_sum", "SELECT 100.0 + coalesce(CAST(sum(l_linenumber) AS DOUBLE), 0) AS total FROM lineitem")
def fold_sum(spark, sf_dir):
    return actions.fold(table(spark, sf_dir, "lineitem"), F.col("l_linenumber"), 100.0, "total")


@query(
    "max_value",
    "SELECT max(o_totalprice) AS high, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders",
)
def max_value(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.max("o_totalprice").alias("high"),
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"),
    )


@query(
    "min_value",
    "SELECT min(o_totalprice) AS low, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders",
)
def min_value(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.min("o_totalprice").alias("low"),
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"),
    )


@query("reduce_sum", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def reduce_sum(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.sum("l_linenumber").alias("total"))


@query("reduce_two_level", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def reduce_two_level(spark, sf_dir):
    return grouping.two_level(
        table(spark, sf_dir, "lineitem"), ["l_orderkey"], 64,
        [F.sum("l_linenumber").alias("t")], [F.sum("t").alias("total")],
    )


@query("take_n", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def take_n(spark, sf_dir):
    return actions.take(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 25, "o_orderkey")


@query(
    "take_ordered",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20",
)
def take_ordered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return actions.take(orders, 20, "o_totalprice", "o_orderkey")


@query(
    "top_n",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20",
)
def top_n(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return actions.top(orders, 20, "o_totalprice", "o_orderkey")


@query(
    "take_sample",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 50",
)
def take_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return actions.take_sample(orders, 50, "o_orderkey", seed=42)


DRAWS, DRAW_PARTS = 500, 16


@query(
    "take_sample_replaced",
    f"""WITH placed AS (
        SELECT o_orderkey, o_totalprice, CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) % {DRAW_PARTS} AS part
        FROM orders
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY part ORDER BY md5('42:' || o_orderkey), o_orderkey) AS place FROM placed
    ), parts AS (
        SELECT part, count(*) AS n, sum(count(*)) OVER (ORDER BY part) AS upto FROM placed GROUP BY part
    ), draws AS (
        SELECT i AS draw, CAST('0x' || substr(md5('42:draw ' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM orders) AS spot
        FROM range({DRAWS}) r(i)
    )
    SELECT draw, o_orderkey, o_totalprice FROM draws JOIN parts ON spot >= upto - n AND spot < upto
        JOIN numbered ON numbered.part = parts.part AND place = spot - (upto - n) + 1""",
)
def take_sample_replaced(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return actions.draw_with_replacement(orders, DRAWS, "o_orderkey", seed=42, parts=DRAW_PARTS)


@query(
    "distinct_from_sketches",
    """SELECT year(CAST(o_orderdate AS DATE)) AS year, count(DISTINCT o_custkey) AS n_distinct, true AS close, true AS same
       FROM orders GROUP BY 1""",
)
def distinct_from_sketches(spark, sf_dir):
    """Customers of each year from sketches of its months, stored once: near the exact number, and as from all rows."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    dated = orders.select("o_custkey", F.year("day").alias("year"), F.month("day").alias("month"))
    months = cut(actions.distinct_sketches(dated, ["year", "month"], "o_custkey"), "sketches")
    merged = actions.sketched_counts(actions.merged_sketches(months, ["year"])).withColumnRenamed("estimate", "merged")
    whole = actions.sketched_counts(actions.distinct_sketches(dated, ["year"], "o_custkey"))
    exact = dated.groupBy("year").agg(F.count_distinct("o_custkey").alias("n_distinct"))
    close = F.abs(F.col("merged") - F.col("n_distinct")) <= F.ceil(4 * 1.04 / 64 * F.col("n_distinct"))
    # Both have the same registers; the estimate from one that was never merged may use more than those.
    same = F.abs(F.col("merged") - F.col("estimate")) <= F.ceil(0.05 * F.col("estimate"))
    return exact.join(merged, "year").join(whole, "year").select("year", "n_distinct", close.alias("close"), same.alias("same"))


def _within(group: str) -> str:
    """SQL of an estimate at 95 % within 5 %: the fewest of 1, 2, 4, ... 64 buckets that make every group's bounds narrow."""
    own = f"{group}, " if group else ""
    return f"""WITH placed AS (
        SELECT {own}CAST('0x' || substr(md5('42:' || o_orderkey), 1, 8) AS BIGINT) % 64 AS place FROM orders
        WHERE o_totalprice > 1000
    ), upto AS (
        SELECT {own}k, count(*) AS n FROM placed JOIN (VALUES (1), (2), (4), (8), (16), (32), (64)) b(k) ON place < k
        GROUP BY {own}k
    ), reached AS (
        SELECT min(k) AS k FROM (SELECT k FROM upto GROUP BY k
            HAVING bool_and(1.959963984540054 * sqrt(n * (1 - k / 64.0)) <= 0.05 * n) OR k = 64)
    )
    SELECT {own}CAST(k AS INT) AS buckets_read, n AS sampled, n * 64.0 / k AS estimate,
        round((n - 1.959963984540054 * sqrt(n * (1 - k / 64.0))) * 64 / k, 6) AS low,
        round((n + 1.959963984540054 * sqrt(n * (1 - k / 64.0))) * 64 / k, 6) AS high
    FROM upto JOIN reached USING (k)"""


def _priced(orders):
    return orders.where(F.col("o_totalprice") > 1000)


@query("count_to_confidence", _within(""))
def count_to_confidence(spark, sf_dir):
    return _rounded(actions.count_within(table(spark, sf_dir, "orders"), "o_orderkey", work=_priced))


@query("count_by_value_to_confidence", _within("o_orderpriority"))
def count_by_value_to_confidence(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return _rounded(actions.count_within(orders, "o_orderkey", by=["o_orderpriority"], work=_priced))


def _three_most(counts: Counter) -> Counter:
    return Counter({q: counts[q] for q in sorted(counts)[-3:]})


def _take_quantities(counts: Counter, batch: pa.RecordBatch) -> Counter:
    found = batch.column(0).drop_null().value_counts()
    return _three_most(counts + Counter({x["values"].as_py(): x["counts"].as_py() for x in found}))


@query(
    "aggregate_states",
    """SELECT l_quantity AS quantity, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL
       GROUP BY l_quantity ORDER BY l_quantity DESC LIMIT 3""",
)
def aggregate_states(spark, sf_dir):
    """The three largest different quantities and how often they occur, as one state merged in a tree."""
    return states.aggregate(
        table(spark, sf_dir, "lineitem").select("l_quantity"), Counter, _take_quantities, lambda a, b: _three_most(a + b),
        lambda counts: [{"quantity": q, "n": n} for q, n in counts.items()],
        StructType.fromDDL("quantity double, n long"), depth=3, fan=4,
    )


@query(
    "table_function_by_key",
    """SELECT l_returnflag, l_quantity, n FROM (
        SELECT l_returnflag, l_quantity, count(*) AS n,
            row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS place
        FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_returnflag, l_quantity) WHERE place <= 3""",
)
def table_function_by_key(spark, sf_dir):
    return states.top_counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query(
    "grouped_function_by_key",
    """SELECT l_linestatus, round(exp(avg(ln(CASE WHEN l_extendedprice > 0 THEN l_extendedprice END))), 4) AS mean,
        count(CASE WHEN l_extendedprice > 0 THEN 1 END) AS n FROM lineitem GROUP BY l_linestatus""",
)
def grouped_function_by_key(spark, sf_dir):
    means = states.geometric_means(table(spark, sf_dir, "lineitem"), "l_linestatus", "l_extendedprice")
    return means.withColumn("mean", F.round("mean", 4))


def _rounded(estimates):
    return estimates.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})
