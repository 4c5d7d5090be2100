"""PageRank and transitive closure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import split_whitespace
from millrace.operators.ordered import Running, running, with_blocks
from millrace.session import cut, forget, location, remove, stored_by

# Fixed values of the rank update.
BASE_RANK = 0.15
DAMPING = 0.85

#: Links of a source that go to one task.
LINKS_PER_SALT = 1_000_000


def parse_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """``src dst`` lines to pairs; further fields are ignored."""
    fields = split_whitespace(F.col(column))
    return lines.select(F.get(fields, F.lit(0)).alias("src"), F.get(fields, F.lit(1)).alias("dst"))


def pagerank(pairs: DataFrame, rounds: int, links_per_salt: int = LINKS_PER_SALT) -> DataFrame:
    """Ranks after ``rounds`` updates over the distinct ``(src, dst)`` pairs.

    Not normalised. A node without in-links is gone after the first round and the
    rank of a node without out-links flows nowhere.

    The links are stored once, dealt by source and salt; the links of a source have one
    salt for every ``links_per_salt`` of them, so a source with very many is spread. A
    link names its source's degree and its target's number of salts, so a round needs
    no other table: ranks are stored in the same layout, join the links without a
    shuffle, and only shares pre-summed in their task and the new ranks move. Each
    round's table goes when the next one is written.
    """
    spark = pairs.sparkSession
    distinct = cut(pairs.select("src", "dst").distinct(), "links")
    out = cut(
        distinct.groupBy("src")
        .agg(F.count(F.lit(1)).alias("degree"))
        .withColumn("salts", F.ceil(F.col("degree") / links_per_salt).cast("int")),
        "degrees",
    )
    into = out.select(F.col("src").alias("dst"), F.col("salts").alias("dst_salts"))
    salted = distinct.join(out, "src").join(into, "dst", "left").select(
        "src", F.pmod(F.xxhash64("dst"), F.col("salts")).cast("int").alias("salt"), "degree", "dst",
        F.coalesce("dst_salts", F.lit(1)).alias("dst_salts"),
    )
    links = stored_by(salted, "links", "src", "salt")
    ranks = _stored_ranks(out.select("src", "salts", F.lit(1.0).alias("rank")))
    for _ in range(rounds):
        share = F.col("rank") / F.col("degree")
        updated = (
            spark.table(ranks)
            .join(spark.table(links), ["src", "salt"])
            .groupBy(F.col("dst").alias("src"), F.col("dst_salts").alias("salts"))
            .agg((F.lit(BASE_RANK) + F.lit(DAMPING) * F.sum(share)).alias("rank"))
        )
        before, ranks = ranks, _stored_ranks(updated)
        forget(spark, before)
    forget(spark, links)
    forget(spark, ranks, keep_files=True)
    for table in (distinct, out):
        _discard(table)
    found = spark.read.parquet(location(spark, ranks))
    return found.where("salt = 0").select(F.col("src").alias("node"), "rank")


def _stored_ranks(ranks: DataFrame) -> str:
    """A rank for each salt of its node, in the layout of the links."""
    salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    return stored_by(ranks.select("src", salt, "rank"), "ranks", "src", "salt")


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def swap(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """All pairs joined by a path, as ``within``, ``src``, ``dst`` and ``hops``.

    ``hops`` is the length of the shortest path. Each round doubles the length
    covered: a pair 2^k + d hops apart is one that is 2^k apart followed by one at
    most 2^k apart, so only the pairs exactly 2^k apart need extending, and a graph of
    depth D takes log2(D) rounds. It is complete when no pair is that far apart.

    Known pairs are written once and never again, dealt by where they begin and, in a
    second copy, by the pair. A round's new pairs are the only rows that are shuffled:
    they meet the first copy to become longer and the second to drop what is known. A
    null node joins nothing.
    """
    spark = edges.sparkSession
    start = [*within, "src"]
    pair = [*start, "dst"]
    fresh = cut(edges.select(*pair, F.lit(1).alias("hops")).distinct(), "paths")
    begun, known, used = stored_by(fresh, "begun", *start), stored_by(fresh, "known", *pair), [fresh]
    reach = 1
    while not fresh.where(F.col("hops") == reach).isEmpty():
        heads = fresh.where(F.col("hops") == reach).select(*start, F.col("dst").alias("mid"))
        tails = spark.table(begun).select(*within, F.col("src").alias("mid"), "dst", F.col("hops").alias("rest"))
        longer = heads.join(tails, [*within, "mid"]).groupBy(*pair).agg(F.min(F.col("rest") + reach).alias("hops"))
        fresh = cut(longer.join(spark.table(known), pair, "left_anti"), "paths")
        stored_by(fresh, "begun", *start, into=begun)
        stored_by(fresh, "known", *pair, into=known)
        used.append(fresh)
        reach *= 2
    forget(spark, begun)
    forget(spark, known, keep_files=True)
    for table in used:
        _discard(table)
    return spark.read.schema(edges.select(*pair).withColumn("hops", F.lit(1)).schema).parquet(location(spark, known))


def _discard(table: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote, once nothing reads it."""
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        remove(table.sparkSession, folder)


def reach(edges: DataFrame, roots: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``within, root, node``: every node that a root reaches, itself included.

    ``roots`` has ``within`` and ``root``. Steps of exactly 2^k edges are made from those
    of half the length, and each kind is taken once from all nodes reached so far: as
    every length is a sum of different powers of two, that finds all nodes in
    log2(depth) rounds. What is kept for the roots is the result alone, linear along a
    chain, and so are the steps. Cycles end it too, once steps are longer than there
    are edges. Null nodes join nothing.
    """
    group = list(within)
    steps = cut(edges.select(*group, "src", "dst").distinct(), "steps")
    longest, length, used = steps.count(), 1, [steps]
    reached = cut(roots.select(*group, "root", F.col("root").alias("node")).distinct(), "reached")
    while not steps.isEmpty():
        onward = reached.join(steps.withColumnRenamed("src", "node"), [*group, "node"])
        used.append(reached)
        reached = cut(reached.union(onward.select(*group, "root", F.col("dst").alias("node"))).distinct(), "reached")
        length *= 2
        if length > longest:
            break
        halves = steps.select(*group, "src", F.col("dst").alias("mid"))
        steps = cut(
            halves.join(steps.withColumnRenamed("src", "mid"), [*group, "mid"]).select(*group, "src", "dst").distinct(),
            "steps",
        )
        used.append(steps)
    for table in used:
        _discard(table)
    return reached


def successor_edges(
    rows: DataFrame, group: str, position: Column, key: str, pieces: int | None = None
) -> DataFrame:
    """Edges from each row of a group to the next one by ``position``."""
    placed = with_blocks(
        rows.select(F.col(group).alias("_group"), position.alias("_at"), F.col(key).alias("_key")),
        ["_group"],
        F.col("_at"),
        pieces,
    )
    linked = running(placed, ["_group"], ["_at"], src=Running("last", F.col("_key")))
    return linked.where(F.col("src").isNotNull()).select("src", F.col("_key").alias("dst"))
