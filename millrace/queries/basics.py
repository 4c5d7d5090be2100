"""Sources, projections, joins, sets and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.sampling import bucket
from millrace.functions.text import ACCESS_LOG, LOG_FIELDS, log_parts, split_space, split_whitespace
from millrace.functions.vectors import dot, format_vector, parse_labelled, parse_vector, squared_distance
from millrace.operators import grouping, relational
from millrace.operators.actions import count_rows
from millrace.plans import clustering, graph
from millrace.queries.registry import query, table
from millrace.session import shared_path
from millrace.sources import committed, files

DOCUMENT_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents)"

# Weights of the order priorities.
PRIORITY_WEIGHTS = [
    ("1-URGENT", 5), ("2-HIGH", 4), ("3-MEDIUM", 3), ("4-NOT SPECIFIED", 2), ("5-LOW", 1),
]


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("value")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label"
    )


VECTORS = "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-log lines written out of the event table; every 13th is malformed."""
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long")
    user = F.when(k % 10 == 0, "-").otherwise(F.concat(F.lit("u"), "user_id"))
    size = F.when(k % 7 == 0, "-").otherwise(F.floor("value").cast("string"))
    line = F.concat(
        F.lit("10.0."), (F.col("user_id") / 256).cast("long"), F.lit("."), F.col("user_id") % 256,
        F.lit(" - "), user, F.lit(' [01/Jan/2024:00:00:00 +0000] "GET /'), "event_type",
        F.lit(' HTTP/1.1" 200 '), size, F.lit(' "http://example.com/" "browser"'),
    )
    return table(spark, sf_dir, "events").select(
        F.when(k % 13 == 0, F.concat(F.lit("malformed "), "event_type")).otherwise(line).alias("value")
    )


LOG_LINES = """ev AS (
    SELECT *, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k FROM events
), lines AS (
    SELECT CASE WHEN k % 13 = 0 THEN 'malformed ' || event_type ELSE
        '10.0.' || (user_id // 256) || '.' || (user_id % 256) || ' - '
        || CASE WHEN k % 10 = 0 THEN '-' ELSE 'u' || user_id END
        || ' [01/Jan/2024:00:00:00 +0000] "GET /' || event_type || ' HTTP/1.1" 200 '
        || CASE WHEN k % 7 = 0 THEN '-' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END
        || ' "http://example.com/" "browser"' END AS value
    FROM ev
)"""
LOG_REGEX = f"'{ACCESS_LOG}'"


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")
    )


# Sources and sinks


@query(
    "text_roundtrip",
    f"WITH {DOCUMENT_LINES} SELECT value, count(*) AS n FROM lines GROUP BY value",
)
def text_roundtrip(spark, sf_dir):
    path = shared_path(spark, "text")
    files.write_lines(document_lines(spark, sf_dir).select("value"), path)
    return files.read_lines(spark, path, separator="\n").groupBy("value").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "literal_rows",
    "SELECT priority, weight, count(*) AS orders FROM orders JOIN (VALUES "
    + ", ".join(f"('{p}', {w})" for p, w in PRIORITY_WEIGHTS)
    + ") AS v(priority, weight) ON o_orderpriority = priority GROUP BY priority, weight",
)
def literal_rows(spark, sf_dir):
    weights = files.literal_rows(spark, PRIORITY_WEIGHTS, "priority string, weight int", partitions=2)
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return orders.join(weights, "priority").select("priority", "weight", "orders")


@query("columnar_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def columnar_roundtrip(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    path = shared_path(spark, "columns")
    files.write_columns(orders, path)
    return files.read_columns(spark, path, orders.schema)


@query("kmeans_model_roundtrip", "SELECT count(*) AS agreed FROM embeddings WHERE embedding IS NOT NULL")
def kmeans_model_roundtrip(spark, sf_dir):
    """Vectors that the model and its reloaded copy put to the same centre."""
    points = vectors(spark, sf_dir)
    model = clustering.library_kmeans(points)
    path = shared_path(spark, "kmeans-model")
    files.save_model(model, path)
    both = model.transform(clustering.features(points)).withColumnRenamed("prediction", "before")
    both = files.load_model(path).transform(both)
    return both.where(F.col("before") == F.col("prediction")).agg(F.count(F.lit(1)).alias("agreed"))


@query("partition_sink", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def partition_sink(spark, sf_dir):
    seen, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def effect(batch):
        seen.add(batch.num_rows)
        total.add(int(batch.column(0).to_numpy().sum()))

    files.for_each_batch(table(spark, sf_dir, "lineitem").select("l_linenumber"), effect)
    return spark.createDataFrame([(seen.value, total.value)], "n long, total long")


@query("for_each_row", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def for_each_row(spark, sf_dir):
    """Effects of single rows, counted by accumulators: a task adds to them once, when it has ended well."""
    seen, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def effect(row):
        seen.add(1)
        total.add(row.o_orderkey)

    files.for_each_row(table(spark, sf_dir, "orders").select("o_orderkey"), effect)
    return spark.createDataFrame([(seen.value, total.value)], "n long, total long")


@query("for_each_partition", "SELECT count(*) AS n, CAST(max(o_orderkey) AS BIGINT) AS largest FROM orders")
def for_each_partition(spark, sf_dir):
    """Each partition leaves a line, in a sink that commits: how many rows it had, and its largest key."""

    def effect(rows):
        keys = [row.o_orderkey for row in rows]
        return [f"{len(keys)} {max(keys)}"] if keys else []

    orders = table(spark, sf_dir, "orders").select("o_orderkey").repartition(PARTITIONS, "o_orderkey")
    lines = committed.results_of_partitions(orders, effect, shared_path(spark, "committed"))
    parts = F.split("value", " ")
    return lines.agg(F.sum(parts[0].cast("long")).alias("n"), F.max(parts[1].cast("long")).alias("largest"))


# Projection, filter, scalar, array and string


@query(
    "map_project",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem",
)
def map_project(spark, sf_dir):
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net"))


@query("key_value", "SELECT o_custkey AS key, o_totalprice AS value FROM orders")
def key_value(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value")
    )


@query(
    "flat_map_words",
    f"""WITH {DOCUMENT_LINES}
    SELECT doc_id, unnest(CASE WHEN value <> '' AND rtrim(value, ' ') = '' THEN []
                          ELSE string_split(rtrim(value, ' '), ' ') END) AS word FROM lines""",
)
def flat_map_words(spark, sf_dir):
    return relational.flat_map(document_lines(spark, sf_dir), split_space(F.col("value")), "word", "doc_id")


@query(
    "flat_map_pairs",
    "SELECT l_orderkey, unnest(['part', 'supplier']) AS kind, unnest([l_partkey, l_suppkey]) AS id FROM lineitem",
)
def flat_map_pairs(spark, sf_dir):
    ends = F.array(
        F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("id")),
        F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("id")),
    )
    lines = table(spark, sf_dir, "lineitem")
    return relational.flat_map(lines, ends, "end", "l_orderkey").select("l_orderkey", "end.*")


@query("map_values", "SELECT c_custkey AS key, round(0.15 + c_acctbal * 0.85, 4) AS value FROM customer")
def map_values(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value")
    )
    return pairs.withColumn("value", F.round(F.lit(0.15) + F.col("value") * 0.85, 4))


@query("values_only", "SELECT l_quantity AS value FROM lineitem")
def values_only(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("value"))


@query("swap_edges", "SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem")
def swap_edges(spark, sf_dir):
    return graph.swap(part_supplier(spark, sf_dir))


@query(
    "split_space",
    f"""WITH {DOCUMENT_LINES}, t AS (
        SELECT doc_id, CASE WHEN value <> '' AND rtrim(value, ' ') = '' THEN []
                       ELSE string_split(rtrim(value, ' '), ' ') END AS tokens FROM lines)
    SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n, array_to_string(tokens, '|') AS tokens FROM t""",
)
def split_space_query(spark, sf_dir):
    tokens = split_space(F.col("value"))
    return document_lines(spark, sf_dir).select(
        "doc_id", F.size(tokens).alias("n"), F.concat_ws("|", tokens).alias("tokens")
    )


@query(
    "split_ws",
    """SELECT doc_id, CAST(len(regexp_split_to_array(text, '\\s+')) AS INTEGER) AS n,
           array_to_string(regexp_split_to_array(text, '\\s+'), '|') AS tokens FROM documents""",
)
def split_ws(spark, sf_dir):
    fields = split_whitespace(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(fields).alias("n"), F.array_join(fields, "|").alias("tokens")
    )


@query(
    "parse_edges",
    "SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem",
)
def parse_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.format_string("p%d \ts%d  1.0", "l_partkey", "l_suppkey").alias("value")
    )
    return graph.parse_edges(lines)


@query(
    "parse_vector",
    f"""WITH {VECTORS} SELECT id, CAST(len(x) AS INTEGER) AS dims, x[1] AS head, x[len(x)] AS tail,
        round(list_sum(x), 6) AS total FROM vectors""",
)
def parse_vector_query(spark, sf_dir):
    parsed = vectors(spark, sf_dir).select("id", format_vector(F.col("x")).alias("text")).select(
        "id", parse_vector(F.col("text")).alias("x")
    )
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return parsed.select(
        "id", F.size("x").alias("dims"), F.get("x", F.lit(0)).alias("head"),
        F.element_at("x", -1).alias("tail"), F.round(total, 6).alias("total"),
    )


@query(
    "parse_labelled",
    f"""WITH {VECTORS} SELECT id, CAST(label AS DOUBLE) AS y, CAST(len(x) AS INTEGER) AS dims,
        x[1] AS head, x[len(x)] AS tail, round(list_sum(x), 6) AS total FROM vectors""",
)
def parse_labelled_query(spark, sf_dir):
    text = F.concat_ws(" ", F.col("label").cast("string"), format_vector(F.col("x")))
    y, x = parse_labelled(F.col("text"))
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return vectors(spark, sf_dir).select("id", text.alias("text")).select(
        "id", y.alias("y"), F.size(x).alias("dims"), F.get(x, F.lit(0)).alias("head"),
        F.element_at(x, -1).alias("tail"), F.round(total, 6).alias("total"),
    )


@query(
    "log_fields",
    f"WITH {LOG_LINES} SELECT "
    + ", ".join(f"regexp_extract(value, {LOG_REGEX}, {i + 1}) AS {name}" for i, name in enumerate(LOG_FIELDS))
    + f", regexp_matches(value, {LOG_REGEX}) AS matched FROM lines",
)
def log_fields(spark, sf_dir):
    rows = log_lines(spark, sf_dir).withColumn("parts", log_parts(F.col("value"), *LOG_FIELDS))
    rows = rows.select((F.col("parts") != F.col("value")).alias("matched"), F.split("parts", "\n").alias("parts"))
    fields = [F.when(F.col("matched"), F.col("parts")[i]).otherwise("").alias(name) for i, name in enumerate(LOG_FIELDS)]
    return rows.select(*fields, "matched")


NATION_EDGES = """edges AS (
    SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey)"""


@query(
    "no_self_loops",
    f"WITH {NATION_EDGES} SELECT src, dst, count(*) AS n FROM edges WHERE src <> dst GROUP BY src, dst",
)
def no_self_loops(spark, sf_dir):
    edges = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
    )
    return graph.without_self_loops(edges).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _neighbours(spark, sf_dir):
    points = vectors(spark, sf_dir).select("id", "x")
    following = points.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return points.join(following, "id")


@query(
    "vec_dot",
    f"""WITH {VECTORS} SELECT a.id, round(list_dot_product(a.x, b.x), 6) AS dot
        FROM vectors a JOIN vectors b ON a.id = b.id - 1""",
)
def vec_dot(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("id", F.round(dot(F.col("x"), F.col("y")), 6).alias("dot"))


@query(
    "vec_sqdist",
    f"""WITH {VECTORS} SELECT a.id, round(list_distance(a.x, b.x) ** 2, 6) AS sqdist
        FROM vectors a JOIN vectors b ON a.id = b.id - 1""",
)
def vec_sqdist(spark, sf_dir):
    return _neighbours(spark, sf_dir).select(
        "id", F.round(squared_distance(F.col("x"), F.col("y")), 6).alias("sqdist")
    )


@query(
    "nearest_center",
    f"""WITH {VECTORS}, seeds AS (
        SELECT x, row_number() OVER (ORDER BY md5('42:' || id), id) AS c
        FROM (SELECT * FROM vectors ORDER BY md5('42:' || id), id LIMIT 4)),
    d AS (SELECT v.id, s.c, list_distance(v.x, s.x) ** 2 AS dist FROM vectors v CROSS JOIN seeds s)
    SELECT id, CAST(arg_min(c, dist) AS INTEGER) AS center, round(min(dist), 6) AS sqdist FROM d GROUP BY id""",
)
def nearest_center(spark, sf_dir):
    points = vectors(spark, sf_dir)
    centers = clustering.seed_centers(points, 4, 42)
    near = points.select("id", clustering.nearest(F.col("x"), centers).alias("n"))
    return near.select("id", F.col("n.center").alias("center"), F.round("n.distance", 6).alias("sqdist"))


@query(
    "out_degree",
    """SELECT src, count(*) AS degree FROM (
        SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem) GROUP BY src""",
)
def out_degree(spark, sf_dir):
    return part_supplier(spark, sf_dir).distinct().groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


# Join, set and grouping


@query(
    "join_inner",
    """SELECT o_orderkey, o_custkey, l_partkey, l_quantity
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def join_inner(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity"
    )
    return relational.inner_join(orders, lines, ["o_orderkey"])


#: So few that some orders of the test tables get several salts.
ROWS_PER_SALT = 4


@query(
    "salted_join",
    """SELECT o_orderkey, o_custkey, l_linenumber, l_partkey
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
)
def salted_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    hot = relational.hot_keys(lines, "o_orderkey", ROWS_PER_SALT)
    large = relational.salted(lines, hot, "o_orderkey", F.col("l_partkey"))
    small = relational.replicated(orders, hot, "o_orderkey")
    return relational.inner_join(large, small, ["o_orderkey", "salt"]).drop("salt")


@query(
    "union_all",
    """SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
       UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""",
)
def union_all(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal")
    )
    return relational.union_all(customers, suppliers)


@query("distinct_pairs", "SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem")
def distinct_pairs(spark, sf_dir):
    return part_supplier(spark, sf_dir).distinct()


#: Values of one list, so few that the test tables give several lists a key.
LIST_PIECE = 100
REDUCERS = 6

GROUPED = f"""WITH numbered AS (
        SELECT l_suppkey, l_partkey, row_number() OVER (
            PARTITION BY l_suppkey ORDER BY l_orderkey * 8 + l_linenumber, l_partkey) AS number FROM lineitem
    ) SELECT l_suppkey, CAST((number - 1) // {LIST_PIECE} AS BIGINT) AS chunk,
        string_agg(l_partkey, ',' ORDER BY number) AS parts"""


def _parts_of_suppliers(spark, sf_dir, partitions=None):
    lists = grouping.value_lists(
        table(spark, sf_dir, "lineitem"), ["l_suppkey"],
        F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_partkey"), "parts", LIST_PIECE, partitions,
    )
    return lists.withColumn("parts", F.array_join(F.col("parts").cast("array<string>"), ","))


@query("group_values", f"{GROUPED} FROM numbered GROUP BY ALL")
def group_values(spark, sf_dir):
    return _parts_of_suppliers(spark, sf_dir)


@query("group_values_in_tasks", f"{GROUPED}, true AS in_tasks FROM numbered GROUP BY ALL")
def group_values_in_tasks(spark, sf_dir):
    """The same by a given number of grouping tasks; ``in_tasks`` says that the row comes from one of them."""
    lists = _parts_of_suppliers(spark, sf_dir, REDUCERS)
    return lists.withColumn("in_tasks", F.spark_partition_id() < REDUCERS)


@query(
    "reduce_by_key",
    "SELECT l_partkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_partkey",
)
def reduce_by_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "reduce_stats_by_key",
    """SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
           round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY l_suppkey""",
)
def reduce_stats_by_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
    )


UNNESTED = f"{VECTORS}, e AS (SELECT label, unnest(x) AS v, unnest(range(len(x))) AS dim FROM vectors)"


@query(
    "vector_mean",
    f"""WITH {UNNESTED} SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) + 0.0 AS mean, count(*) AS n
        FROM e GROUP BY label, dim""",
)
def vector_mean(spark, sf_dir):
    means = grouping.vector_means(vectors(spark, sf_dir), ["label"], "x")
    return means.select("label", "dim", (F.round("mean", 6) + 0.0).alias("mean"), "n")


@query(
    "vector_sum",
    f"WITH {UNNESTED} SELECT CAST(dim AS INTEGER) AS dim, round(sum(v), 6) + 0.0 AS total FROM e GROUP BY dim",
)
def vector_sum(spark, sf_dir):
    sums = grouping.vector_sums(vectors(spark, sf_dir), [], "x")
    return sums.select("dim", (F.round("total", 6) + 0.0).alias("total"))


MD5_BUCKET = "CAST('0x' || substr(md5({seed} || ':' || {key}), 1, 8) AS BIGINT) % {n}"
PARTITIONS = 16


@query(
    "rows_by_partition",
    f"""WITH placed AS (
        SELECT CAST({MD5_BUCKET.format(seed="'7'", key="o_orderkey", n=PARTITIONS)} AS INTEGER) AS partition, o_orderkey
        FROM orders
    ), numbered AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY o_orderkey) AS number FROM placed)
    SELECT partition, CAST((number - 1) // {LIST_PIECE} AS BIGINT) AS chunk, string_agg(o_orderkey, ',' ORDER BY number) AS keys
    FROM numbered GROUP BY ALL""",
)
def rows_by_partition(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lists = grouping.partition_lists(
        orders, "o_orderkey", bucket(7, F.col("o_orderkey"), PARTITIONS), PARTITIONS, LIST_PIECE
    )
    return lists.withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ","))
