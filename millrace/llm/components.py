"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.streams import saved

#: Links that a task holds at once.
HELD = 1 << 20


def joined(links: np.ndarray) -> pa.RecordBatch:
    """Links from each node to the smallest one that it reaches by ``links``."""
    nodes, ends = np.unique(links, return_inverse=True)
    a, b = ends.reshape(links.shape).T
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root != root[root]).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.record_batch({"a": pa.array(nodes[moved]), "b": pa.array(nodes[root[moved]])})


def _shortened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, those of each ``a`` side by side, as stars, of ``HELD`` links at a time.

    A node whose links go on after ``HELD`` of them takes its star's link along, so all its ends are joined.
    """
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch["a"].to_numpy(), batch["b"].to_numpy()], axis=1))
        if sum(map(len, held)) >= HELD:
            star = joined(np.concatenate(held))
            yield star
            last = int(np.searchsorted(star["a"].to_numpy(), held[-1][-1, 0]))
            held = [np.array([[star["a"][last].as_py(), star["b"][last].as_py()]])]
    if held:
        yield joined(np.concatenate(held))


def _large_star(links: DataFrame) -> DataFrame:
    """Each link goes on from its lower end to the smallest node that this one has a link to.

    Both sides grow with the links, and both are shuffled when their sizes are known.
    """
    least = links.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("least"))
    return links.join(least.hint("merge"), "b", "left").select("a", F.coalesce("least", "b").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """The lower ends of each node, and whatever else meets in a task, become stars of the smallest."""
    dealt = links.repartition("a").sortWithinPartitions("a")
    return dealt.mapInArrow(_shortened, "a long, b long")


def _open(links: DataFrame) -> DataFrame:
    """Nodes with two lower ends, or with one and also the lower end of others; if there are none, the links are stars."""
    end = lambda node, low: F.struct(F.col(node).alias("node"), low.cast("long").alias("low"))
    ends = links.select(F.explode(F.array(end("a", F.col("b")), end("b", F.lit(None)))).alias("end")).select("end.*")
    nodes = ends.groupBy("node").agg(
        F.min("low").alias("least"), F.max("low").alias("most"), F.max(F.col("low").isNull()).alias("ends_others")
    )
    return nodes.where("least < most or least is not null and ends_others")


def stars(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, component)``: each node that reaches a smaller one, once, and the smallest that it reaches.

    Every round is saved, so a lost executor costs that round. A node's links to
    smaller ones meet in one task, which holds ``HELD`` at a time; from the first round
    on there are as many as tasks at most. All links that end in one node stream through
    one task of a round's join, as 16-byte rows: Spark does not split it, since the other
    side is summed up in it. Null ends and links of a node with itself are left out; no
    links give no rows.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    links = saved(_small_star(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    while True:
        links = saved(_small_star(_large_star(links)))
        if _open(links).isEmpty():
            break
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, component)``: each node that has a link to another, and the smallest node it reaches."""
    heads = stars(links)
    roots = heads.select("component").distinct().select(F.col("component").alias("node"), "component")
    return heads.unionByName(roots)
