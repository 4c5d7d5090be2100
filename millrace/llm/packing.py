"""Packing documents into sequences: best fit, planned over counts of lengths.

The histogram has one entry per length, so the plan is made once, on the driver, from
at most ``capacity`` numbers, however many documents there are. Documents then take
the planned places by their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.streams import TEXT_BYTES, saved
from millrace.llm.tokens import word_encoder

CAPACITY = 4096
END = 1
#: Parts that the documents of one length are numbered in.
PARTS = 256

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each document's ids, then ``end``, cut into pieces of ``capacity`` if there are more: place, length, checksum."""

    def cut(batches):
        encoder = word_encoder(tokenizer)
        for batch in batches:
            for first, ids, upto in encoder.encode(batch["text"], end):
                total = np.diff(upto)
                number = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(total[doc] - start, capacity)
                begin = upto[:-1][doc] + start
                sums = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"].take(pa.array(first + doc)), "piece": pa.array(piece.astype(np.int32)),
                        "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return typed.mapInArrow(cut, PIECE)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over ``{length: how many}``, as runs ``(length, first rank, how many, first sequence, per
    sequence, offset)``.

    The documents of a run fill sequences one after the other, ``per sequence`` in each,
    from ``offset`` on. Sequences that are equally full are one entry, so the work grows
    with the number of lengths and not of documents.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)
    rooms: list[int] = []
    runs, sequences = [], 0

    def give(room: int, first: int, many: int) -> None:
        if room and many:
            if not free[room]:
                bisect.insort(rooms, room)
            free[room].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = free[room].pop()
                if not free[room]:
                    rooms.pop(at)
            else:
                room, first, many = capacity, sequences, -(-left // (capacity // length))
                sequences += many
            each = room // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - room))
                give(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < many:  # the last of them take one sequence, part of the way
                runs.append((length, rank, left, first + full, each, capacity - room))
                give(room - left * length, first + full, 1)
                full, left = full + 1, 0
            give(room, first + full, many - full)
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Only documents of more than ``capacity`` tokens are cut. A null text is empty and
    has the end id alone. Rows that repeat a document are packed each; a null doc_id
    stays null. No rows give no rows. Other columns are not read.
    """
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(PARTS))
    found = saved(pieces(docs, tokenizer, capacity, end), TEXT_BYTES).withColumn("part", part)
    parts = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = saved(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    sent = docs.sparkSession.sparkContext.broadcast((runs, runs[:, 0] * (1 << 40) + runs[:, 1]))

    def placed(batches):
        runs, keys = sent.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            run = runs[np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1] if len(length) else runs[:0]
            within = rank - run[:, 1]
            columns = {n: batch[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(run[:, 3] + within // np.maximum(run[:, 4], 1))
            columns["offset"] = pa.array(run[:, 5] + within % np.maximum(run[:, 4], 1) * length)
            yield pa.record_batch(columns)

    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = found.join(parts.drop("n"), ["length", "part"]).withColumn(
        "rank", F.col("before") + F.row_number().over(within) - 1
    )
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(placed, f"{PIECE}, sequence_id long, offset long")
