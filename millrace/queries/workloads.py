"""Whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans import clustering, counts, graph, regression, text_jobs
from millrace.queries.basics import (
    DOCUMENT_LINES, LOG_LINES, LOG_REGEX, VECTORS, document_lines, log_lines, part_supplier, vectors,
)
from millrace.queries.registry import query, table

PAGERANK_ROUNDS = 6
KMEANS_K, KMEANS_SEED = 4, 42
KMEANS_CONVERGE = 1e-9
#: Rounds written out in SQL; what has converged earlier no longer moves.
KMEANS_SQL_ROUNDS = 40
LOGISTIC_ROUNDS = 4


@query(
    "word_count",
    f"""WITH {DOCUMENT_LINES}, words AS (
        SELECT unnest(CASE WHEN value <> '' AND rtrim(value, ' ') = '' THEN []
                      ELSE string_split(rtrim(value, ' '), ' ') END) AS word FROM lines)
    SELECT word, count(*) AS n FROM words GROUP BY word""",
)
def word_count(spark, sf_dir):
    return text_jobs.word_count(document_lines(spark, sf_dir))


ROLLUP = f"""{LOG_LINES}, fields AS (
    SELECT regexp_extract(value, {LOG_REGEX}, 1) AS ip, regexp_extract(value, {LOG_REGEX}, 3) AS usr,
        regexp_extract(value, {LOG_REGEX}, 5) AS query,
        coalesce(TRY_CAST(regexp_extract(value, {LOG_REGEX}, 7) AS BIGINT), 0) AS bytes FROM lines
), keyed AS (
    SELECT CASE WHEN ip <> '' AND usr <> '-' THEN ip END AS ip,
        CASE WHEN ip <> '' AND usr <> '-' THEN usr END AS "user",
        CASE WHEN ip <> '' AND usr <> '-' THEN query END AS query, bytes FROM fields
), rollup AS (
    SELECT ip, "user", query, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM keyed GROUP BY ALL
)"""


@query("log_rollup", f"WITH {ROLLUP} SELECT * FROM rollup")
def log_rollup(spark, sf_dir):
    return text_jobs.log_rollup(log_lines(spark, sf_dir))


@query(
    "log_rollup_text",
    f"""WITH {ROLLUP} SELECT ip, "user", query, printf('bytes=%d\tn=%d', bytes, n) AS stats FROM rollup""",
)
def log_rollup_text(spark, sf_dir):
    return text_jobs.rollup_text(text_jobs.log_rollup(log_lines(spark, sf_dir)))


def _pagerank_sql() -> str:
    steps = [
        """WITH pairs AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem),
        links AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs),
        deg AS (SELECT src, count(*) AS degree FROM links GROUP BY src),
        r0 AS (SELECT src AS node, CAST(1.0 AS DOUBLE) AS rank FROM deg)"""
    ]
    for i in range(PAGERANK_ROUNDS):
        steps.append(
            f"""r{i + 1} AS (SELECT dst AS node, 0.15 + 0.85 * sum(rank / degree) AS rank
            FROM links JOIN deg USING (src) JOIN r{i} ON r{i}.node = links.src GROUP BY dst)"""
        )
    return ",\n".join(steps) + f" SELECT node, round(rank, 6) AS rank FROM r{PAGERANK_ROUNDS}"


@query("pagerank", _pagerank_sql())
def pagerank(spark, sf_dir):
    pairs = part_supplier(spark, sf_dir)
    ranks = graph.pagerank(graph.swap(pairs).unionByName(pairs), PAGERANK_ROUNDS)
    return ranks.select("node", F.round("rank", 6).alias("rank"))


def order_chain(spark, sf_dir):
    """Edges from each order to the customer's next one by date, then order number."""
    orders = table(spark, sf_dir, "orders")
    position = F.struct(F.col("o_orderdate").cast("date"), "o_orderkey")
    return graph.successor_edges(orders, "o_custkey", position, "o_orderkey")


ORDER_CHAIN = """ordered AS (
    SELECT o_orderkey AS dst, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS src
    FROM orders), edges AS (SELECT src, dst FROM ordered WHERE src IS NOT NULL)"""


@query("next_order", f"WITH {ORDER_CHAIN} SELECT src, dst FROM edges")
def next_order(spark, sf_dir):
    return order_chain(spark, sf_dir)


@query(
    "transitive_closure",
    f"""WITH RECURSIVE {ORDER_CHAIN}, tc AS (
        SELECT src, dst FROM edges UNION SELECT e.src, tc.dst FROM edges e JOIN tc ON e.dst = tc.src)
    SELECT src, dst FROM tc""",
)
def transitive_closure(spark, sf_dir):
    return graph.closure(order_chain(spark, sf_dir)).select("src", "dst")


def _trained_sql() -> str:
    steps = [
        f"""{VECTORS}, c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY md5('{KMEANS_SEED}:' || id), id) AS c, x
            FROM (SELECT * FROM vectors ORDER BY md5('{KMEANS_SEED}:' || id), id LIMIT {KMEANS_K}))"""
    ]
    for i in range(KMEANS_SQL_ROUNDS):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT v.id, any_value(v.x) AS x, arg_min(k.c, list_distance(v.x, k.x)) AS c
                FROM vectors v CROSS JOIN c{i} k GROUP BY v.id),
            e{i} AS (SELECT c, unnest(x) AS v, unnest(range(len(x))) AS dim FROM a{i}),
            m{i} AS (SELECT c, dim, avg(v) AS v FROM e{i} GROUP BY c, dim),
            n{i} AS (SELECT c, list(v ORDER BY dim) AS x FROM m{i} GROUP BY c),
            c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(n{i}.x, k.x) AS x FROM c{i} k LEFT JOIN n{i} ON k.c = n{i}.c)"""
        )
    return ",\n".join([*steps, f"trained AS (SELECT * FROM c{KMEANS_SQL_ROUNDS})"])


TRAINED = _trained_sql()


def lloyd_centers(spark, sf_dir):
    return clustering.lloyd(
        vectors(spark, sf_dir), KMEANS_K, converge=KMEANS_CONVERGE, seed=KMEANS_SEED
    )


@query(
    "kmeans_lloyd",
    f"""WITH {TRAINED}
    SELECT CAST(c AS INTEGER) AS center, CAST(dim AS INTEGER) AS dim, round(v, 4) + 0.0 AS value
    FROM (SELECT c, unnest(x) AS v, unnest(range(len(x))) AS dim FROM trained)""",
)
def kmeans_lloyd(spark, sf_dir):
    rows = [
        (i + 1, d, v) for i, center in enumerate(lloyd_centers(spark, sf_dir)) for d, v in enumerate(center)
    ]
    centers = spark.createDataFrame(rows, "center int, dim int, value double")
    return centers.withColumn("value", F.round("value", 4) + 0.0)


@query(
    "kmeans_ml",
    f"""WITH {VECTORS}, shape AS (SELECT CAST(max(len(x)) AS INTEGER) AS dims FROM vectors)
    SELECT CAST(unnest(range(2)) AS INTEGER) AS center, dims, true AS is_mean FROM shape""",
)
def kmeans_ml(spark, sf_dir):
    """Each centre of the library's model, and whether it is the mean of its members."""
    points = vectors(spark, sf_dir)
    off = clustering.centers_off_means(points, clustering.library_kmeans(points))
    return off.select("center", "dims", (F.col("off") < 1e-3).alias("is_mean"))


@query(
    "kmeans_wssse",
    f"""WITH {TRAINED},
    d AS (SELECT v.id, min(list_distance(v.x, t.x) ** 2) AS d FROM vectors v CROSS JOIN trained t GROUP BY v.id)
    SELECT round(sum(d), 4) AS wssse FROM d""",
)
def kmeans_wssse(spark, sf_dir):
    centers = lloyd_centers(spark, sf_dir)
    return clustering.squared_error(vectors(spark, sf_dir), centers).select(F.round("wssse", 4).alias("wssse"))


#: First weights written out in SQL, enough for the longest vector of the test tables.
LOGISTIC_SQL_DIMS = 64


def _logistic_sql() -> str:
    first = ", ".join(f"CAST({w!r} AS DOUBLE)" for w in regression.first_weights(LOGISTIC_SQL_DIMS))
    steps = [
        f"""WITH {VECTORS}, points AS (
            SELECT id, CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END::DOUBLE AS y, x FROM vectors),
        s0 AS MATERIALIZED (SELECT list_slice([{first}], 1, (SELECT max(len(x)) FROM vectors)) AS w)"""
    ]
    for r in range(LOGISTIC_ROUNDS):
        steps.append(
            f"""p{r} AS (SELECT x, (1 / (1 + exp(-y * list_dot_product(w, x))) - 1) * y AS pull FROM points CROSS JOIN s{r}),
            e{r} AS (SELECT pull, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS dim FROM p{r}),
            g{r} AS (SELECT dim, sum(pull * v) AS g FROM e{r} GROUP BY dim),
            s{r + 1} AS MATERIALIZED (SELECT list(w[dim] - g ORDER BY dim) AS w FROM g{r} CROSS JOIN s{r})"""
        )
    return ",\n".join(steps) + f"""
        SELECT CAST(dim AS INTEGER) AS dim, round(weight, 4) + 0.0 AS weight
        FROM (SELECT unnest(w) AS weight, unnest(range(len(w))) AS dim FROM s{LOGISTIC_ROUNDS})"""


@query("logreg_gd", _logistic_sql())
def logreg_gd(spark, sf_dir):
    points = vectors(spark, sf_dir).select(F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("y"), "x")
    first = regression.first_weights(regression.dimensions(points))
    weights = regression.logistic_weights(points, first, LOGISTIC_ROUNDS)
    df = spark.createDataFrame(list(enumerate(weights)), "dim int, weight double")
    return df.withColumn("weight", F.round("weight", 4) + 0.0)


@query("group_key_count", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def group_key_count(spark, sf_dir):
    return counts.group_count(table(spark, sf_dir, "lineitem"), "l_partkey")


@query(
    "indicator_ratio",
    f"""WITH {VECTORS} SELECT round(4.0 * sum(CASE WHEN 25 * (x[1] * x[1] + x[2] * x[2]) <= 1 THEN 1 ELSE 0 END)
        / count(*), 6) AS ratio FROM vectors""",
)
def indicator_ratio(spark, sf_dir):
    a, b = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    inside = 25 * (a * a + b * b) <= 1
    return counts.indicator_ratio(vectors(spark, sf_dir), inside, 4.0).select(F.round("ratio", 6).alias("ratio"))
