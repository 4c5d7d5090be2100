"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

# Weights of the sources in code point order, over and over.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = 11
#: Parts of a source, by the hash of a document; only the part that a fraction ends in is put in order.
PARTS = 4096

_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, budget: float = BUDGET, epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sizes(source_key, source, source_size)`` with ``target``: ``budget`` of all sizes, shared by weight under caps.

    A source is clamped at ``epochs`` times its size, and what it leaves is shared by
    weight among the others, until none is above. Taken in order of cap per weight, the
    clamped ones come first, so one pass over the sources finds the end of that.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (row - 1) % len(WEIGHTS) + 1).cast("double")
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("level", left / weights).withColumn("clamped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)
    return out.select(
        "source_key", "source", "source_size",
        F.when(F.col("clamped"), F.col("cap")).otherwise(level["level"] * F.col("weight")).alias("target"),
    )


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with one struct column ``mix(size, source_size, target, taken)`` more.

    Size is the number of words. A source's target is met by whole repetitions of all
    its documents and a fraction more: documents in order of a seeded hash, until the
    fraction is used up, the last in part. So the words taken are the target, rounded,
    and none is taken more than twice. Null and blank texts have size 0 and nothing
    taken; a null source is a source, the last; equal rows are documents each. A source
    without words has target 0. No rows give no rows. A column ``mix`` is replaced.
    """
    docs = docs.drop("mix") if "mix" in docs.columns else docs
    info = F.struct(
        F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("source").isNull(), F.col("source")).alias("source_key"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.hash("text")).alias("order"),
    )
    rows = docs.withColumn("mix", info)
    part = F.pmod(F.col("mix.order"), F.lit(PARTS))
    parts = rows.groupBy(F.col("mix.source_key").alias("source_key"), "source", part.alias("part")).agg(
        F.sum("mix.size").alias("words")
    )
    sizes = parts.groupBy("source_key", "source").agg(F.sum("words").alias("source_size"))
    wanted = targets(sizes).withColumn("whole", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    wanted = wanted.withColumn("extra", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size"))
    upto = Window.partitionBy("source_key").orderBy("part")
    ended = parts.select("source_key", "part", "words", F.sum("words").over(upto).alias("upto"))
    ended = ended.join(wanted, "source_key").where("upto - words <= extra and extra < upto")
    ended = ended.groupBy("source_key").agg(F.min("part").alias("end_part"), F.min_by(F.expr("upto - words"), "part").alias("used"))
    # One row for each source; not hinted, so it is sent to all tasks only while it is small. It is written first, for
    # while its size is not known, all texts are shuffled to it.
    shares = wanted.join(ended, "source_key", "left").select(
        F.col("source_key").alias("mix_key"),
        F.struct("source_size", "target", "whole", "extra", F.coalesce("end_part", F.lit(PARTS)).alias("end_part"), "used")
        .alias("mix_share"),
    )
    joined = rows.join(cut(shares, "mix-shares"), F.col("mix.source_key") == F.col("mix_key"))
    size, share = F.col("mix.size"), F.col("mix_share")

    def finished(frame: DataFrame, extra) -> DataFrame:
        result = F.struct(
            size.alias("size"), share["source_size"].alias("source_size"), share["target"].alias("target"),
            (size * share["whole"] + extra).alias("taken"),
        )
        return frame.select(*docs.columns, result.alias("mix"))

    zero = F.lit(0).cast("long")
    clear = finished(joined.where(part != share["end_part"]), F.when(part < share["end_part"], size).otherwise(zero))
    order = Window.partitionBy("mix.source_key").orderBy("mix.order", "doc_id", "mix.size")
    passed = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), zero)
    last = finished(
        joined.where(part == share["end_part"]),
        F.greatest(zero, F.least(size, share["extra"] - share["used"] - passed)),
    )
    return clear.unionByName(last)


def sampled(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken; a part of one keeps its first words.

    Documents without words stay once, for they weigh nothing. Columns are those of ``docs``.
    """
    rows = mixed(docs, seed)
    size, taken = F.col("mix.size"), F.col("mix.taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(1).cast("long"))
    rest = F.when(size > 0, taken % size).otherwise(F.lit(0).cast("long"))
    times = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>"))
    )
    blank = r"[\\x20\\x09-\\x0D]"
    first = F.expr(
        rf"regexp_extract(text, concat('^{blank}*+(?:[^\\x20\\x09-\\x0D]++{blank}*+){{', cast(mix_words - 1 as string), "
        rf"'}}+[^\\x20\\x09-\\x0D]++'), 0)"
    )
    rows = rows.select("*", F.explode(times).alias("mix_words"))
    text = F.when(F.col("mix_words") > 0, first).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*docs.columns)
