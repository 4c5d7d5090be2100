"""A corpus pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import dedup, language, mixing, packing, pii
from millrace.llm.queries import WORD_TOKENIZER
from millrace.llm.streams import BATCH_BYTES, TEXT_BYTES, table
from millrace.session import shared_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language, with the one found for them; texts without a letter go."""
    return language.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return dedup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; the last of a source in part."""
    return mixing.sampled(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and place of each piece of the mix."""
    return packing.pack(docs, WORD_TOKENIZER)


def _in_small_batches(stage):
    """The stage in a session that hands texts to Python, and takes them back, ``TEXT_BYTES`` at a time from now on.

    Stages share executors and their workers, and what one leaves behind counts for the
    next. A stage's frame is read by the caller, so the setting has to outlast it.
    """

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_BYTES, str(TEXT_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded


STAGES = [
    (stage.__name__, _in_small_batches(stage))
    for stage in (language_id, near_duplicates, personal_data, source_mix, best_fit_packing)
]

#: Hashes of sketches, learned models and a tokenizer have no SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH_BYTES)
    try:
        for name, stage in STAGES:
            path = shared_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_BYTES, before)
    return docs
