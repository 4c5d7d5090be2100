"""Every stage's decisions against plain Python, each on its own input, and the whole run."""

import re

import corpus_pipeline
from millrace.llm.streams import BATCH_BYTES, TEXT_BYTES
from tests.llm.fixtures import odd_documents, words
from tests.llm.test_dedup import brute
from tests.llm.test_texts import check_packed


def test_stages_one_after_the_other(spark, sf_dir, tmp_path):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        assert name == "best_fit_packing" or docs.columns == columns
    text = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    before, after = map(text, seen["language_id"])
    assert sorted(after) == sorted((d, t) for d, t in before if re.search(r"[^\W\d_]", t or ""))
    before, after = map(text, seen["near_duplicates"])
    assert sorted(d for d, _ in after) == sorted(d for d, _, _, kept in brute(before) if kept)
    before, after = map(dict, map(text, seen["personal_data"]))
    assert before.keys() == after.keys()
    assert all(before[d] == t for d, t in after.items() if not re.search("[0-9@]", before[d]))
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", t) for t in after.values())
    before, after = map(text, seen["source_mix"])
    size, mixed = (sum(len(words(t)) for _, t in rows) for rows in (before, after))
    assert abs(mixed - 1.5 * size) <= 20
    rows = [(d, t, None) for d, t in after]
    used, tokens = check_packed(seen["best_fit_packing"][1], rows, 4096)
    assert used <= -(-tokens // 4096) + 1


def test_run_takes_odd_rows(spark, tmp_path):
    odd_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_every_stage_gets_texts_in_small_batches(spark, tmp_path):
    before = spark.conf.get(BATCH_BYTES)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(BATCH_BYTES, str(64 << 20))
            stage(spark, odd_documents(spark), str(tmp_path))
            assert spark.conf.get(BATCH_BYTES) == str(TEXT_BYTES)
        spark.conf.set(BATCH_BYTES, str(32 << 20))
        odd_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
        corpus_pipeline.run(spark, str(tmp_path))
        assert spark.conf.get(BATCH_BYTES) == str(32 << 20)
    finally:
        spark.conf.set(BATCH_BYTES, before)
