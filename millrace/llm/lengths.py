"""Token counts of a corpus for every context limit, from an exact histogram of encoded lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.streams import saved
from millrace.llm.tokens import word_encoder

#: Lengths of one block of the suffix sums.
BLOCK = 1024


def histogram(docs: DataFrame, tokenizer: str, end: int | None = None) -> DataFrame:
    """``length, docs``: how many documents encode to each number of tokens. A null text is empty."""

    def counts(batches):
        encoder = word_encoder(tokenizer)
        for batch in batches:
            found = [np.diff(upto) for _, _, upto in encoder.encode(batch["text"], end)]
            lengths, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.record_batch({"length": pa.array(lengths.astype(np.int64)), "docs": pa.array(n.astype(np.int64))})

    texts = docs.select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(counts, "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))
    return saved(counted)  # it is small and read more than once


def length_table(histogram: DataFrame) -> DataFrame:
    """One row for each length that occurs, which answers every question about limits.

    ``length, docs, tokens``; ``docs_longer`` and ``tokens_longer`` of strictly longer
    documents; ``docs_at_most`` (its share of all is the quantile's level); ``truncated``:
    tokens left when every document is cut to this length; ``total_docs, total_tokens``.
    No documents give no rows. Suffix sums run within blocks of lengths, and over the
    few block totals.
    """
    rows = histogram.withColumn("tokens", F.col("docs") * F.col("length")).withColumn(
        "block", F.floor(F.col("length") / BLOCK)
    )
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(after), zero).alias("later_docs"),
        F.coalesce(F.sum("block_tokens").over(after), zero).alias("later_tokens"),
        F.sum("block_docs").over(every).alias("total_docs"),
        F.sum("block_tokens").over(every).alias("total_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(blocks, "block").select(
        "length", "docs", "tokens",
        (F.col("later_docs") + F.coalesce(F.sum("docs").over(longer), zero)).alias("docs_longer"),
        (F.col("later_tokens") + F.coalesce(F.sum("tokens").over(longer), zero)).alias("tokens_longer"),
        "total_docs", "total_tokens",
    )
    return out.withColumns(
        {
            "docs_at_most": F.col("total_docs") - F.col("docs_longer"),
            "truncated": F.col("total_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer"),
        }
    )


def quantile(table: DataFrame, share: float) -> DataFrame:
    """``length``: the smallest length that at least ``share`` of the documents do not exceed."""
    return table.where(F.col("docs_at_most") >= F.lit(share) * F.col("total_docs")).agg(F.min("length").alias("length"))


def truncated_total(table: DataFrame, limit: int) -> DataFrame:
    """``tokens``: what is left when every document is cut to ``limit`` tokens; 0 for no documents."""
    kept = F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("docs"))
    return table.agg(F.coalesce(kept, F.lit(0).cast("long")).alias("tokens"))
