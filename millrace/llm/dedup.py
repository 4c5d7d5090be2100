"""Near-duplicate groups by MinHash with tensored banding.

Two small collections of half keys are made, each half key from ``ROWS`` minhashes.
Every pair of a half key of the first and one of the second collection is a table
key: ``HALVES`` squared tables from only ``2 * HALVES * ROWS`` minhashes. Two sets of
similarity s share a table unless all half keys of one collection differ: at most
2 * (1 - s**ROWS)**HALVES, which is 1 in 10,000 at the threshold and falls fast above.

What shares a table is compared by its minhashes, which gives rough groups; within
these, all sets are compared in full. Both steps together lose a pair with
probability 1.02e-4 at the threshold and 6.6e-5, 2.6e-5 and 9.5e-6 at 0.76, 0.78
and 0.80, if nothing else links it. Exact copies are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from millrace.llm.buffers import mix, shingle_sets
from millrace.llm.components import joined, stars
from millrace.llm.streams import bounds, by_group, fixed_binary, saved, to_fixed_binary, whole_groups

WIDTH = 5
ROWS = 2
HALVES = 12
HASHES = 2 * HALVES * ROWS
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Share of equal minhashes, 22 of 48, from which two sets are of one rough group. A pair at the threshold that shares a
#: table has fewer with probability 3.2e-6 (exact, with bytes equal by chance), far below the loss of the tables.
ROUGH = 0.45
#: Aimed size of the blocks that large buckets and rough groups are cut into; blocks meet pairwise, none is left out.
BUCKET_BLOCK = 4096
GROUP_BLOCK = 512
GROUP_SHINGLES = 2_000_000
#: One megabyte.
FILTER_BITS = 1 << 23

_RANDOM = np.random.default_rng(20240607)
_FACTORS = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def _set_ids(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One hash for each set, whatever the order of its members."""
    return mix(np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), starts) + sizes.astype(np.uint64)).view(np.int64)


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, values, upto in shingle_sets(batch["text"], WIDTH):
            sizes = np.diff(upto)
            full = sizes > 0
            starts, n = upto[:-1][full], int(full.sum())
            least = np.empty((n, HASHES), np.uint64)
            for k in range(HASHES if n else 0):
                least[:, k] = np.minimum.reduceat(values * _FACTORS[k] + _ADDENDS[k], starts)
            halves = np.zeros((n, 2 * HALVES), np.uint64)
            for k in range(ROWS):
                halves = mix(halves * np.uint64(31) + least[:, k::ROWS] + np.arange(2 * HALVES, dtype=np.uint64))
            at = np.full(len(sizes), -1)
            at[full] = np.arange(n)
            none = pa.array(at, mask=~full)
            ids = pa.array(_set_ids(values, starts, sizes[full]) if n else np.zeros(0, np.int64))
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"].slice(first, len(sizes)),
                    "n_shingles": pa.array(sizes.astype(np.int64)),
                    "node": ids.take(none),
                    "halves": to_fixed_binary(halves).take(none),
                    "sketch": to_fixed_binary((least >> np.uint64(40)).astype(np.uint8)).take(none),
                }
            )


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, node, halves, sketch`` of every row; the last three are null where there are no words."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return typed.mapInArrow(_signatures, "doc_id long, n_shingles long, node long, halves binary, sketch binary")


def _table_keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 2048):
            part = batch.slice(first, 2048)
            halves = fixed_binary(part["halves"], np.uint64)
            pairs = mix(halves[:, :HALVES, None] * np.uint64(0x9E3779B97F4A7C15) + halves[:, None, HALVES:])
            yield pa.record_batch(
                {
                    "key": pa.array(pairs.reshape(-1).view(np.int64)),
                    "node": pa.array(np.repeat(part["node"].to_numpy(), HALVES * HALVES)),
                }
            )


def _spread(sketches: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what rough similarity joins: from each set to those that nothing has reached before."""
    links, left = [], np.arange(len(sketches))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = (sketches[left] == sketches[one]).mean(axis=1) >= ROUGH
            reached = left[near].tolist()
            links += [(one, other) for other in reached]
            queue += reached
            left = left[~near]
    return links


def _rough_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in whole_groups(batches):
        cell, node = group["cell"].to_numpy(), group["node"].to_numpy()
        sketches = fixed_binary(group["sketch"], np.uint8)
        edges = bounds(cell)
        head = np.repeat(edges[:-1], np.diff(edges))
        near = (sketches == sketches[head]).mean(axis=1) >= ROUGH
        a, b = [node[head[near]]], [node[near]]
        far = np.add.reduceat(~near, edges[:-1])
        for k in np.flatnonzero(far):  # only where the first of a bucket does not reach all others
            first, last = edges[k], edges[k + 1]
            for one, other in _spread(sketches[first:last]):
                a.append(node[first + one : first + one + 1])
                b.append(node[first + other : first + other + 1])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key has others, numbered in blocks; holds one row of the row's bucket at most."""
    last_key, last_node, passed = None, 0, 0
    for batch in batches:
        key, node = batch["key"].to_numpy(), batch["node"].to_numpy()
        if not len(key):
            continue
        edges = bounds(key)
        length = np.diff(edges)
        at = np.arange(len(key)) - np.repeat(edges[:-1], length)
        total = length.copy()
        waiting = None
        if key[0] == last_key:
            at[: length[0]] += passed
            total[0] += passed
            waiting = last_node if passed == 1 else None
        keep = np.repeat(total > 1, length)
        parts = [key[keep], node[keep], at[keep] // BUCKET_BLOCK]
        if waiting is not None:
            parts = [np.append(p, x) for p, x in zip(parts, (last_key, waiting, 0), strict=True)]
        yield pa.record_batch({n: pa.array(p) for n, p in zip(("key", "node", "block"), parts, strict=True)})
        last_key, last_node, passed = key[-1], node[-1], int(total[-1])


def rough_links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links that span, within every bucket of every table, what minhashes say is similar.

    Table keys are shuffled once, and those that one set alone has are dropped as
    they stream by. A larger bucket is cut into blocks, and every two blocks meet.
    """
    keys = nodes.mapInArrow(_table_keys, "key long, node long").repartition("key").sortWithinPartitions("key")
    shared = saved(keys.mapInArrow(_shared, "key long, node long, block long"))
    blocks = shared.where("block > 0").groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    rows = shared.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    cells = by_group(_meetings(rows, "key").join(nodes.select("node", "sketch"), "node"), "key", "i", "j", least=("node",))
    return cells.select("cell", "node", "sketch").mapInArrow(_rough_links, "a long, b long")


def _meetings(rows: DataFrame, *keep: str) -> DataFrame:
    """Each row once for every pair of blocks ``i <= j`` that has its own block in it."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return rows.select(*keep, "node", "block", other.alias("other")).select(
        *keep, "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )


def _full_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of the threshold that join what all such links join, by full intersections."""
    sizes = np.array([len(s) for s in sets])
    names = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(names.max()) + 1, np.int64)
    links, left = [], np.arange(len(sets))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            one = queue.pop()
            own = names[starts[one] : starts[one + 1]]
            fits = left[(100 * np.minimum(sizes[left], sizes[one]) >= PERCENT * np.maximum(sizes[left], sizes[one]))]
            if not len(fits):
                continue
            mark[own] = 1
            upto = np.concatenate([[0], np.cumsum(sizes[fits])])
            at = np.repeat(starts[fits] - upto[:-1], sizes[fits]) + np.arange(upto[-1])
            both = np.add.reduceat(mark[names[at]], upto[:-1])
            mark[own] = 0
            reached = fits[100 * both >= PERCENT * (sizes[fits] + sizes[one] - both)]
            links += [(one, other) for other in reached.tolist()]
            queue += reached.tolist()
            left = left[~np.isin(left, reached)]
    return links


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in whole_groups(batches):
        cell, node = group["cell"].to_numpy(), group["node"].to_numpy()
        edges = bounds(cell)
        a, b = [], []
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            sets: dict[int, np.ndarray] = {}
            for begin, values, upto in shingle_sets(group["text"].slice(first, last - first).combine_chunks(), WIDTH):
                full = np.flatnonzero(np.diff(upto))
                ids = _set_ids(values, upto[:-1][full], np.diff(upto)[full]) if len(full) else []
                for k, name in zip(full.tolist(), ids, strict=True):
                    if name == node[first + begin + k]:  # else another text with the same doc_id
                        sets[int(name)] = values[upto[k] : upto[k + 1]]
            names = list(sets)
            for one, other in _full_links([*sets.values()]) if len(names) > 1 else []:
                a.append(names[one])
                b.append(names[other])
        yield joined(np.array([a, b], np.int64).T)


def _nodes_of(texts: pa.Array) -> np.ndarray:
    """The set id of each text; 0 where there are no words."""
    out = np.zeros(len(texts), np.int64)
    for first, values, upto in shingle_sets(texts, WIDTH):
        full = np.flatnonzero(np.diff(upto))
        if len(full):
            out[first + full] = _set_ids(values, upto[:-1][full], np.diff(upto)[full])
    return out


def _members_only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, node, text`` of all rows whose id, or lack of one, is in ``ids`` and a few others, before they are shuffled.

    The ids set bits in one array of a fixed ``FILTER_BITS`` bits, whatever their
    number; the more there are, the fewer other rows it holds back. A row's node is
    that of its own text, and rows of a batch that repeat an id with it go.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {FILTER_BITS}) & 63 as int))")).alias("bits")
    )
    found = words.toArrow()  # one job, and FILTER_BITS / 64 rows at most
    array = np.zeros(FILTER_BITS // 64, np.int64)
    array[found["word"].to_numpy()] = found["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(array)

    def known(batches):
        for batch in batches:
            at = batch["bit"].to_numpy()
            hit = (sent.value[at >> 6] >> (at & 63)) & 1
            part = batch.filter(pa.array(hit == 1))
            node, named = _nodes_of(part["text"]), part["doc_id"]
            who = [node, named.fill_null(0).to_numpy(), named.is_null().to_numpy(zero_copy_only=False)]
            once = np.unique(np.stack(who, axis=1), axis=0, return_index=True)[1]
            once = pa.array(np.sort(once[node[once] != 0]))
            yield pa.record_batch(
                {"doc_id": part["doc_id"].take(once), "node": pa.array(node).take(once), "text": part["text"].take(once)}
            )

    return docs.withColumn("bit", bit).mapInArrow(known, "doc_id long, node long, text string")


def _checked(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """``cells(node, doc_id, group, i, j)``: stars of the links on full sets within each ``(group, i, j)``."""
    texts = texts.select(F.col("doc_id").alias("text_id"), F.col("node").alias("text_node"), "text")
    own = (F.col("node") == F.col("text_node")) & F.col("doc_id").eqNullSafe(F.col("text_id"))
    rows = by_group(cells.join(texts, own).select("group", "i", "j", "node", "text"), "group", "i", "j")
    return rows.select("cell", "node", "text").mapInArrow(_verified, "a long, b long")


def full_groups(nodes: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, component``, as ``stars`` has them: what links of the threshold join within each rough group.

    A group is cut into blocks. First each block is compared within itself, together
    with the group's first node. That one is the smallest and all that blocks share,
    so their stars are those of the group. Only for groups that are still in parts, the
    nodes outside the largest part then meet all nodes of the group, block by block.
    """
    members = nodes.select("node", "doc_id", "n_shingles").join(groups.hint("merge"), "node", "left")
    members = members.withColumn("group", F.coalesce("component", "node")).drop("component")
    sizes = members.groupBy("group").agg(
        F.count("*").alias("n"),
        F.greatest(F.ceil(F.count("*") / GROUP_BLOCK), F.ceil(F.sum("n_shingles") / GROUP_SHINGLES)).alias("blocks"),
    )
    members = members.join(sizes.where("n > 1").drop("n"), "group")
    members = saved(members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")))
    count = lambda name: F.sequence(F.lit(0).cast("long"), F.col(name) - 1)
    blocks = F.when(F.col("node") == F.col("group"), count("blocks")).otherwise(F.array("block"))
    within = members.select("node", "doc_id", "group", F.explode(blocks).alias("i")).withColumn("j", F.col("i"))
    texts = _members_only(docs, members)
    found = saved(_checked(within, texts)).toDF("node", "component")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return found
    parts = large.join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = parts.groupBy("group", "component").agg(F.count("*").alias("n"))
    main = counted.groupBy("group").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    parts = saved(parts.join(main, "group").withColumn("rest", F.col("component") != F.col("main")))
    if parts.where("rest").isEmpty():
        return found
    rest = parts.where("rest").groupBy("group").agg(F.ceil(F.count("*") / GROUP_BLOCK).alias("rest_blocks"))
    rows = parts.join(rest, "group").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), "rest_blocks"))
    left = rows.where("rest").select("node", "doc_id", "group", F.col("part").alias("i"), F.explode(count("blocks")).alias("j"))
    right = rows.select("node", "doc_id", "group", F.explode(count("rest_blocks")).alias("i"), F.col("block").alias("j"))
    return stars(found.toDF("a", "b").union(_checked(left.union(right).distinct(), texts)))


def _grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, node, component, component_id`` of every row; ``component`` is a node, null as ``node`` is."""
    signed = saved(signatures(docs))
    nodes = saved(
        signed.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"),
            F.first("halves").alias("halves"), F.first("sketch").alias("sketch"),
        )
    )
    found = full_groups(nodes, stars(rough_links(nodes)), docs)
    named = nodes.select("node", "doc_id").join(found.hint("merge"), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(least, "component").select("node", "component", "component_id")
    return signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text, ...)``.

    Sets are the distinct runs of five words, or all words where there are fewer.
    Rows with equal sets are linked. A null or blank text has an empty set, no links
    and its own doc_id as component. Rows that share a doc_id are all returned, each
    with the component of its own set; a null doc_id never names a component unless
    all doc_ids in it are null. No rows give no rows. Other columns are not read.
    """
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return _grouped(docs).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


@F.arrow_udf(LongType())
def _node_of(texts: pa.Array) -> pa.Array:
    node = _nodes_of(texts)
    return pa.array(node, mask=node == 0)


_node = _node_of.asNondeterministic()  # a filter on it is not pushed below it, which would count it twice


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, the one of the smallest doc_id, and all rows without words.

    A row stays by its own text: a copy of another document never stands in for a
    text of the same doc_id. Rows without an id are documents of their own; a group
    of such rows alone keeps one. Of several texts of a doc_id that would stay, the
    one of the smallest set id does.
    """
    worded = _grouped(docs).where(F.col("node").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    alone = F.when(F.col("doc_id").isNull(), F.col("component"))
    kept = worded.groupBy(F.col("doc_id").alias("kept_id"), alone.alias("kept_of")).agg(F.min("node").alias("kept_node"))
    text = F.col("text").cast("string")
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), _node(text).alias("own_node"))
    same = (F.col("own_node") == F.col("kept_node")) & F.col("own_id").eqNullSafe(F.col("kept_id"))
    once = rows.join(kept, same).dropDuplicates(["kept_id", "kept_node"]).select("row.*")
    return once.union(docs.where(blank))
