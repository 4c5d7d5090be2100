"""What the two vector searches share: shards of distinct vectors, queries streamed by, best rows merged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.streams import bounds

#: Vectors of a shard, about; and queries that are answered at a time.
SHARD = 8192
QUERIES = 1024

Index = Callable[[np.ndarray, np.ndarray], "object"]


def finite(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows that have an id and a vector without null, NaN or infinite components."""
    x = F.col("embedding").cast("array<double>")
    bound = F.lit(float("inf"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (v < bound) & (v > -bound))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & good)


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch["x"].flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1)


def _same(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray], dict[int, int]]:
    """Distinct vectors, the smallest ids of each, and for ids that several of these have, how many.

    Of equal vectors a result never needs more than ``k`` of an id, nor more than the
    first ``2 * k`` of those: whichever id is a query's own, ``k`` others are left.
    """
    x, back = np.unique(x, axis=0, return_inverse=True)
    back = back.ravel()
    order = np.lexsort((ids, back))
    ids, back = ids[order], back[order]
    runs = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (back[1:] != back[:-1])]))
    few = np.arange(len(ids)) - np.repeat(runs, np.diff(np.append(runs, len(ids)))) < k
    own, held = np.unique(ids[runs], return_counts=True)
    several = dict(zip(own[held > 1].tolist(), held[held > 1].tolist(), strict=True))
    ids, back = ids[few], back[few]
    edges = bounds(back)
    return x, [ids[a : min(a + 2 * k, b)] for a, b in zip(edges[:-1], edges[1:], strict=True)], several


def search(
    vectors: DataFrame, is_query: Column, k: int, index: Index, score: str, shard: int = SHARD, *, once: bool = False
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each query row of ``vectors(vec_id, x)``.

    Rows are dealt to shards by a hash. ``index(x, k)`` makes a shard's index from its
    distinct vectors; its ``search(queries, more)`` gives, per query, numbers and scores
    of vectors that hold at least the ``k + more`` best, ties in full. ``more`` is the
    number of vectors that have the query's own id, so ``k`` are left without these.
    Where query rows share an id, ``once`` gives each other row one rank, by its best
    score with any of them; else every pair of rows has a rank of its own. Each shard is one
    stream: its vectors first, then the queries block by block, so a task holds a
    shard and a block whatever the number of queries. Shard results are merged by rank.
    """
    shards = max(1, -(-vectors.count() // shard))
    home = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(shards))
    size = F.size("x").alias("size")  # vectors of other lengths are compared among themselves
    stored = vectors.select(size, home.cast("int").alias("shard"), F.lit(0).alias("ask"), "vec_id", "x")
    asked = vectors.where(is_query).select(
        size, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("ask"), "vec_id", "x"
    )
    asked = asked.dropDuplicates(["shard", "vec_id", "x"]) if once else asked
    rows = stored.union(asked).repartition(shards, "size", "shard").sortWithinPartitions("size", "shard", "ask", "vec_id")

    def answers(batches):
        for kind, x, ids in _runs(batches):
            if kind == 0:
                distinct, names, several = _same(x, ids, k)
                built = index(distinct, k)
            elif built is not None:
                more = np.array([several.get(i, 1) for i in ids.tolist()])
                for n in np.unique(more):
                    ask = np.flatnonzero(more == n)
                    yield _best(built.search(x[ask], int(n)), names, ids[ask], k, x.shape[1], score)
            else:
                continue

    def _runs(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """A shard's vectors as one run of kind 0, its queries in runs of kind 1; a shard without vectors clears the index."""
        nonlocal built
        held: list[tuple[np.ndarray, np.ndarray]] = []
        place = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch[c].to_numpy() for c in ("size", "shard", "ask")], axis=1)
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]])
            edges = np.flatnonzero(new)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here, part = tuple(key[a]), batch.slice(a, b - a)
                if here != place and held:
                    yield 0, *map(np.concatenate, zip(*held, strict=True))
                    held = []
                if place is None or here[:2] != place[:2]:
                    built = None
                if here[2] == 0:
                    held.append((matrix(part), part["vec_id"].to_numpy()))
                else:
                    for first in range(0, b - a, QUERIES):
                        block = part.slice(first, QUERIES)
                        yield 1, matrix(block), block["vec_id"].to_numpy()
                place = here

    built = None
    found = rows.mapInArrow(answers, f"query_id long, vec_id long, size int, place long, score {score}")
    if once:  # an id is in one shard alone for each size, so this names a row
        row = ("query_id", "vec_id", "size", "place")
        found = found.repartition("query_id").groupBy(*row).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best(found, names: list[np.ndarray], queries: np.ndarray, k: int, size: int, score: str) -> pa.RecordBatch:
    """The ``k`` best rows of a shard for each query, without the query's own; ``found`` has numbers and scores per query.

    ``place`` tells rows of the same id apart.
    """
    first = np.concatenate([[0], np.cumsum([len(n) for n in names])])
    out = []
    for query, (numbers, scores) in zip(queries.tolist(), found, strict=True):
        ids = [names[n] for n in numbers]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(first[n], first[n + 1]) for n in numbers]) if ids else np.zeros(0, np.int64)
        value = np.repeat(np.asarray(scores), [len(i) for i in ids])
        other = flat != query
        flat, value, place = flat[other], value[other], place[other]
        top = np.lexsort((place, flat, -value))[:k]
        out.append((np.full(len(top), query), flat[top], place[top], value[top]))
    query, ids, place, value = (np.concatenate(c) for c in zip(*out, strict=True))
    kind = pa.float64() if score == "double" else pa.int64()
    return pa.record_batch(
        {
            "query_id": pa.array(query, pa.int64()), "vec_id": pa.array(ids, pa.int64()),
            "size": pa.array(np.full(len(ids), size), pa.int32()), "place": pa.array(place, pa.int64()),
            "score": pa.array(value, kind),
        }
    )
