"""One query for each operator on its whole table, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, audit, dedup, language, lengths, licenses, maxscore, mixing, packing, pii, toxicity, urls, vptree
from millrace.llm.streams import table

#: Vocabulary files of public tokenizers, where the installed package keeps them.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op6_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.length_table(lengths.histogram(table(spark, sf_dir, "documents"), WORD_TOKENIZER))


@query("op7_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op8_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


@query("op10_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "mix.*")


@query("op3_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents")).select("doc_id", "lang_id.*")


@query("op9_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_nearest_vectors")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    "op5_top_products",
    """WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS DOUBLE)) AS x
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
    ), ranked AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
    ) SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
)
def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.best(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op4_license_spans")
def license_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents"))


@query("op11_token_alignment")
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


@query(
    "op13_filter_audit",
    """WITH own AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
            regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
        FROM documents
    ), first AS (
        SELECT text, min(doc_id) AS least FROM own GROUP BY text
    ), marks AS (
        SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
        FROM labels GROUP BY doc_id
    ), failed AS (
        SELECT own.part, coalesce(marks.good, false) AS good, coalesce(marks.toxic, false) AS toxic,
            (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
            + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
            + (CASE WHEN 100 * length(regexp_replace(own.text, '[^A-Z]', '', 'g')) > 2 * length(own.text) THEN 4 ELSE 0 END)
            + (CASE WHEN regexp_matches(own.text, '[#$%&*|]') THEN 8 ELSE 0 END)
            + (CASE WHEN own.doc_id > first.least THEN 16 ELSE 0 END) AS mask
        FROM own JOIN first ON own.text = first.text LEFT JOIN marks ON own.doc_id = marks.doc_id
    ), counted AS (
        SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
        FROM failed GROUP BY part, mask
    ), letters AS (
        SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS l(letter, bit)
    ), orders AS (
        SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
        FROM letters a JOIN letters b ON b.bit <> a.bit JOIN letters c ON c.bit NOT IN (a.bit, b.bit)
            JOIN letters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN letters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
    ), steps AS (
        SELECT o.filter_order, CAST(s.step AS INTEGER) AS step, l.bit,
            (SELECT coalesce(sum(x.bit), 0) FROM letters x WHERE contains(substr(o.filter_order, 1, s.step - 1), x.letter)) AS before
        FROM orders o CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
            JOIN letters l ON l.letter = substr(o.filter_order, s.step, 1)
    ), found AS (
        SELECT c.part, s.filter_order, s.step, s.bit,
            sum(CASE WHEN c.mask & (s.bit | CAST(s.before AS INTEGER)) = 0 THEN c.n ELSE 0 END) AS kept,
            sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & CAST(s.before AS INTEGER) = 0 THEN c.n ELSE 0 END) AS removed,
            sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & CAST(s.before AS INTEGER) <> 0 THEN c.n ELSE 0 END) AS redundant,
            sum(CASE WHEN c.mask = s.bit THEN c.n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & CAST(s.before AS INTEGER) = 0 THEN c.good ELSE 0 END) AS good_lost,
            sum(CASE WHEN c.mask & s.bit <> 0 AND c.mask & CAST(s.before AS INTEGER) = 0 THEN c.toxic ELSE 0 END) AS toxic_lost
        FROM counted c CROSS JOIN steps s GROUP BY c.part, s.filter_order, s.step, s.bit
    )
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
        CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
    FROM found""",
)
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet")


@query("op12_url_filters")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages).select("page_id", "host", "path", "rule", "verdict")
