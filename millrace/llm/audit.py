"""Audit of filters that are applied in every order, kept up to date by a stream of files.

Which order removes what follows from one number: for each part, how many documents
fail exactly which filters. Those counters are kept by a stream. Four filters need a
document alone; the fifth, being a copy of a text with a smaller id, depends on all
others. So a state keyed by text keeps the smallest id seen and how its documents were
counted; when a smaller id arrives, their counts are taken back and given again as
copies. The state is a table in the shared folder that each micro-batch adds to and
looks its own texts up in, by plain joins and aggregates. (Spark's own keyed state runs
a Python function for each text, at 4 ms a text, ten times all the rest.)
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import cut, shared_path

FILTERS = "ABCDE"
LEAST_WORDS = 200
BLANKS = r"[\x20\x09-\x0D]+"
MARKS = "[#$%&*|]"
COPY = 1 << FILTERS.index("E")
#: Micro-batches that the files are dealt to, if there are as many. Each looks its texts up in the state once, which has
#: about 60 bytes for a text; so all batches together read some sixth of a corpus of texts of 3 KB again.
BATCHES = 8

#: How a row's copy filter stands: it has no id, it may have the smallest, or a smaller one has been seen beside it.
NO_ID, OPEN, SETTLED = 0, 1, 2

_KIND = "part string, mask int, good int, toxic int"
_PARTIAL = f"text_key binary, how int, doc_id long, {_KIND}, n long"
CHANGES = f"{_KIND}, n long"


def failures(text: F.Column) -> F.Column:
    """Bits of the filters A to D that a text fails, which are those of its own alone. ``text`` is not null."""
    words = F.array_remove(F.split(text, BLANKS), "")
    return F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0),
    )[0] + (
        F.when(100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(MARKS), 8).otherwise(0)
    )


def _added(table: pa.Table) -> pa.Table:
    """``n`` summed up by all other columns."""
    keys = [n for n in table.column_names if n != "n"]
    return table.group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def _same_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a text within a batch: those of its smallest id there stay open, all others are copies whatever comes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch["text_key"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        named = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
        ids = batch["doc_id"].fill_null(0).to_numpy()
        least = np.full(int(code.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, code[named], ids[named])
        how = np.where(named, np.where(ids > least[code], SETTLED, OPEN), NO_ID).astype(np.int32)
        columns = {n: batch[n] for n in batch.schema.names}
        columns |= {"how": pa.array(how), "doc_id": pa.array(np.where(how == OPEN, ids, 0))}
        yield from _added(pa.table(columns)).select(_names(_PARTIAL)).to_batches()


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _kinds(copy: bool = False) -> list[F.Column]:
    mask = F.col("mask").bitwiseOR(COPY).alias("mask") if copy else F.col("mask")
    return [F.col("part"), mask, F.col("good"), F.col("toxic")]


def marks_of(labels: DataFrame) -> DataFrame:
    """``id, good, toxic`` of the ids that a label marks as one of them."""
    marked = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("int"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    return marks.agg(marked("quality").alias("good"), marked("toxic").alias("toxic")).where("good + toxic > 0")


def arrivals(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``text_key, how, doc_id, part, mask, good, toxic, n``: documents summed up, per task, by text and what they fail."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"),
        F.lit(1).cast("long").alias("n"),
    )
    marked = rows.join(marks, F.col("doc_id") == F.col("id"), "left").select(
        "text_key", "doc_id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"), "n",
    )
    return marked.mapInArrow(_same_texts, _PARTIAL)


def moves(arrived: DataFrame, state: DataFrame) -> DataFrame:
    """What arriving rows change: ``text_key, doc_id, part, mask, good, toxic, n, first``.

    ``state(text_key, doc_id, part, mask, good, toxic, n)`` has the rows of every text's
    smallest id so far, and perhaps ones of earlier, larger ids, which count no more. Only
    texts that arrive are looked up. Rows with ``first`` are to be added to the state;
    with ``n`` below 0 or the copy bit they correct the counters alone.
    """
    keys = ["text_key", "doc_id", "part", "mask", "good", "toxic"]
    fresh = arrived.where(F.col("how") == OPEN).groupBy(*keys).agg(F.sum("n").alias("n"))
    least = fresh.groupBy("text_key").agg(F.min("doc_id").alias("fresh_least"))
    known = state.select(*keys, "n").join(least, "text_key")
    before = known.groupBy("text_key").agg(F.min("doc_id").alias("known_least"))
    no_more = (F.col("doc_id") == F.col("known_least")) & (F.col("fresh_least") < F.col("known_least"))
    back = known.join(before, "text_key").where(no_more)
    mine = fresh.join(least, "text_key").join(before, "text_key", "left")
    first = F.col("doc_id") == F.least("fresh_least", "known_least")
    mask = F.when(first, F.col("mask")).otherwise(F.col("mask").bitwiseOR(COPY))
    head, no = ["text_key", "doc_id"], F.lit(False).alias("first")
    settled = arrived.where(F.col("how") == SETTLED).select(*head, *_kinds(copy=True), "n", no)
    unnamed = arrived.where(F.col("how") == NO_ID).select(*head, *_kinds(), "n", no)
    return (
        mine.select(*head, "part", mask.alias("mask"), "good", "toxic", "n", first.alias("first"))
        .union(back.select(*head, *_kinds(), (-F.col("n")).alias("n"), no))
        .union(back.select(*head, *_kinds(copy=True), "n", no))
        .union(settled)
        .union(unnamed)
    )


def counters(spark: SparkSession, documents: str, labels: str, batches: int = BATCHES) -> DataFrame:
    """``part, mask, good, toxic, n``: documents of each part that fail exactly the filters of ``mask``.

    Reads the Parquet file or folder of files at ``documents``, all that are there now, by a
    stream of at most ``batches`` micro-batches. Each writes its arrivals, then what they
    add to the state, then its changes of the counters, in folders of its own number: a
    batch that is run again replaces them and reads only those of smaller numbers.
    """
    source = spark.read.parquet(documents)
    files = max(1, math.ceil(len(source.inputFiles()) / batches))
    pattern = f"{documents[:-1]}[{documents[-1]}]"  # a plain path would have to be a folder
    docs = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", str(files)).parquet(pattern)
    path = shared_path(spark, "audit")
    marks = cut(marks_of(spark.read.parquet(labels)), "audit-labels")
    folder = lambda name, batch: f"{path}/{name}/batch={batch}"
    state_schema = f"text_key binary, doc_id long, {CHANGES}"
    spark.createDataFrame([], state_schema).write.parquet(folder("state", -1))
    spark.createDataFrame([], CHANGES).write.parquet(folder("counters", -1))
    def keep(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        arrivals(rows, marks).write.mode("overwrite").parquet(folder("arrivals", batch))
        arrived = session.read.schema(_PARTIAL).parquet(folder("arrivals", batch))
        earlier = [folder("state", k) for k in range(-1, batch)]
        changed = moves(arrived, session.read.schema(state_schema).parquet(*earlier))
        columns = [c.split()[0] for c in state_schema.split(", ")]
        changed.where("first").select(*columns).write.mode("overwrite").parquet(folder("state", batch))
        summed = changed.groupBy(*_names(_KIND)).agg(F.sum("n").alias("n"))
        summed.write.mode("overwrite").parquet(folder("counters", batch))

    stream = docs.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/stream")
    stream.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(CHANGES).parquet(f"{path}/counters")
    return rows.groupBy(*_names(_KIND)).agg(F.sum("n").alias("n")).where("n <> 0")


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every order's steps for each part of ``counters``: the filters' counts are sums over at most 32 masks a part."""
    bit = {name: 1 << k for k, name in enumerate(filters)}
    steps = [
        (order, k + 1, bit[order[k]], sum(bit[f] for f in order[:k]))
        for order in map("".join, itertools.permutations(filters))
        for k in range(len(filters))
    ]
    masks = counted.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    each = F.explode(F.array(*(F.struct(F.lit(o).alias("order"), F.lit(k).alias("step"), F.lit(b).alias("bit"), F.lit(x).alias("before")) for o, k, b, x in steps)))
    rows = parts.select("part", "masks", each.alias("at"))
    own, before = F.col("at.bit"), F.col("at.before")
    zero = F.lit(0).cast("long")
    total = lambda of: F.aggregate("masks", zero, of)
    where = lambda test, value: lambda s, m: s + F.when(test(m["mask"]), value(m)).otherwise(zero)
    fails, gone = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(before) != 0)
    here = lambda m: fails(m) & ~gone(m)
    n = lambda m: m["n"]
    orders = len(steps) // len(filters)
    return rows.select(
        "part", F.col("at.order").alias("filter_order"), F.col("at.step").alias("step"),
        total(where(lambda m: ~fails(m) & ~gone(m), n)).alias("kept"),
        total(where(here, n)).alias("removed"),
        total(where(lambda m: fails(m) & gone(m), n)).alias("redundant"),
        total(where(lambda m: m == own, n)).alias("unique_fails"),
        total(where(here, lambda m: m["good"])).alias("good_lost"),
        total(where(here, lambda m: m["toxic"])).alias("toxic_lost"),
        # Of the filters that a document fails, each comes first in the same share of all orders.
        total(where(fails, lambda m: (m["n"] * orders / F.bit_count(m["mask"])).cast("long"))).alias("shapley"),
    )


def audit(spark: SparkSession, documents: str, labels: str, batches: int = BATCHES) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included, for Parquet files of documents and labels.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``. A null text is empty, and empty texts are copies of each
    other; a null source is the part ''. A row without an id is no copy, makes none and
    has no label. Rows that repeat an id with its text are counted each and are no
    copies of each other. A document is good or toxic if any of its labels says so. No
    documents give no rows. Other columns are not read.
    """
    return interactions(counters(spark, documents, labels, batches))
