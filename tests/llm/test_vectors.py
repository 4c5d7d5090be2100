import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import maxscore, toxicity, vptree
from millrace.llm.queries import QUERIES
from tests.llm.fixtures import odd_documents

SCHEMA = "vec_id long, embedding array<float>, label int, x string, shard int, size int, score double"


def rows_of(values):
    return [(i, v, 0, "x", 1, 2, 0.5) for i, v in values]


def brute(values, k, asked, score):
    out = []
    for q, x in values:
        if asked(q):
            found = sorted((-score(x, y), i) for i, y in values if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def cosine(x, y):
    x, y = (np.array(v, np.float32).astype(float) for v in (x, y))
    return float((x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum())))


def product(x, y):
    x, y = (np.floor(1024 * np.array(v, np.float32).astype(float)) for v in (x, y))
    return sum(int(a) * int(b) for a, b in zip(x, y, strict=True))


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]


def test_nearest_query_recall_and_scores(spark, sf_dir, vectors):
    got = {(r.query_id, r.vec_id): r.score for r in QUERIES["op1_nearest_vectors"](spark, sf_dir).collect()}
    want = {(q, i): s for q, _, i, s in brute(vectors, 5, lambda i: i % 50 == 0, cosine)}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.98 * len(want)
    by_id = dict(vectors)
    assert all(abs(s - cosine(by_id[q], by_id[i])) < 1e-12 for (q, i), s in got.items())


ODD = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [2.0, 0.0, 4.0]), (50, [1.0, 0.0, 2.0]), (100, [-1.0, 3.0, 0.5]), (7, [0.0, 1.0, 0.0])]
ODD += [(k, [1.0, 0.0, 2.0]) for k in range(200, 240)]
BAD = [(300, None), (350, [0.0, None, 1.0]), (400, [float("nan"), 1.0, 1.0]), (500, [float("inf"), 1.0, 1.0]), (600, []), (None, [1.0, 1.0, 1.0])]
ZERO = (700, [0.0, 0.0, 0.0])


@pytest.mark.parametrize("shard", [8192, 10])
def test_nearest_odd_rows(spark, shard, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 2)
    monkeypatch.setattr(vptree.search, "__defaults__", (shard,))
    df = spark.createDataFrame(rows_of([*ODD, *BAD, ZERO]), SCHEMA)
    got = sorted(map(tuple, vptree.nearest(df, F.col("vec_id") % 50 == 0, relax=1.0).collect()))
    want = brute(ODD, 5, lambda i: i % 50 == 0, cosine)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want, strict=True))
    assert [g[2] for g in got if g[0] in (0, 50)] == [1, 2, 50, 200, 201, 0, 1, 2, 200, 201]


@pytest.mark.parametrize("shard", [8192, 10])
def test_products_odd_rows(spark, shard, monkeypatch):
    monkeypatch.setattr(maxscore.search, "__defaults__", (shard,))
    values = [*ODD, ZERO, (800, [-5.0, -5.0, -5.0])]
    df = spark.createDataFrame(rows_of([*values, *BAD]), SCHEMA)
    got = sorted(map(tuple, maxscore.best(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == brute(values, 10, lambda i: i % 100 == 0, product)


REPEATS = [(0, [1.0, 0.0, 2.0]), (0, [1.0, 0.0, 2.0]), (100, [0.0, 1.0, 1.0]), (300, [9.0, 9.0, 8.5])]
REPEATS += [(100, [k / 100, 1.0, 1.0]) for k in range(1, 30)] + [(300, [9.0, 9.0, 9.0])] * 30
REPEATS += [(k, [1.0, k / 9, 1.5]) for k in range(1, 30)] + [(k, [9.0, 9.0, 9.0]) for k in range(400, 440)]


@pytest.mark.parametrize("shard", [8192, 10])
def test_queries_that_repeat_an_id(spark, shard, monkeypatch):
    """Own rows take no place of others; nearest ranks a row once, products every pair of rows as in the SQL."""
    monkeypatch.setattr(vptree, "LEAF", 4)
    monkeypatch.setattr(vptree.search, "__defaults__", (shard,))
    df = spark.createDataFrame(rows_of(REPEATS), SCHEMA)
    near, product_rows = [], []
    for q in (0, 100, 300):
        own, others = [x for i, x in REPEATS if i == q], [(i, x) for i, x in REPEATS if i != q]
        found = sorted((-max(cosine(x, y) for x in own), i) for i, y in others)[:5]
        near += [(q, n + 1, -s) for n, (s, _) in enumerate(found)]
        found = sorted((-product(x, y), i) for x in own for i, y in others)[:10]
        product_rows += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    asked = F.col("vec_id").isin(0, 100, 300)
    got = sorted(map(tuple, vptree.nearest(df, asked, relax=1.0).collect()))
    assert [g[:2] for g in got] == [w[:2] for w in near]
    assert all(abs(g[3] - w[2]) < 1e-12 for g, w in zip(got, near, strict=True))
    assert sorted(map(tuple, maxscore.best(df, asked).collect())) == product_rows


def test_products_of_large_numbers_and_negative_best(spark):
    values = [(0, [3e5, -1.0]), (1, [-2e5, 1.0]), (2, [-4e5, 8.0]), (100, [1e30, 1.0]), (3, [1e30, 2.0])]
    df = spark.createDataFrame(rows_of(values), SCHEMA)
    got = sorted(map(tuple, maxscore.best(df, F.col("vec_id") % 100 == 0).collect()))
    clamp = lambda x, y: min(max(product(x, y), -(1 << 63)), (1 << 63) - 1)
    assert got == brute(values, 10, lambda i: i % 100 == 0, clamp)


def test_exact_for_any_data(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    for relax, least in ((1.0, 1.0), (1.25, 0.9)):
        tree, hits = vptree.VantageTree(x.astype(float), 5, relax), 0
        for q, (rows, scores) in zip(x[:40], tree.search(x[:40].astype(float)), strict=True):
            best = rows[np.argsort(-scores)][:6]
            true = np.argsort(-(x @ q) / np.linalg.norm(x, axis=1))[:6]
            hits += len(set(best.tolist()) & set(true.tolist()))
        assert hits >= least * 240


def test_empty_vectors(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vptree.nearest(df, F.col("vec_id") % 50 == 0).count() == 0
    assert maxscore.best(df, F.col("vec_id") % 50 == 0).count() == 0


# ---- toxicity ----
def test_gradients_agree_with_differences():
    from millrace.llm.recurrent import Network

    rng = np.random.default_rng(0)
    net = Network(4, 3, 1)
    x = rng.standard_normal((6, 4)).astype(np.float32)
    tokens = np.array([[0, 1, 2, -1], [3, 4, 5, 0]])
    slope = np.array([0.7, -0.4], np.float32)
    loss = lambda: float(net.forward(net.projected(x), tokens) @ slope)
    keep = {}
    net.forward(net.projected(x), tokens, keep)
    grads, _ = net.backward(keep, tokens, slope)
    for name in ("uf", "ub", "cf", "attend", "out"):
        flat, g = net.p[name].reshape(-1), np.asarray(grads[name]).reshape(-1)
        for k in range(0, len(flat), 5):
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - g[k]) < 2e-3, name


def test_toxic_texts_are_found(spark, sf_dir):
    spark_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.toxicity(spark_docs, labels).collect()}
    assert len(got) == spark_docs.count()
    held = [d for d in toxic if got[d].held_out]
    assert sum(got[d].predicted == toxic[d] for d in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_toxicity_odd_rows(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, none).collect()} == {(0.0, 0)}
    few = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (6, 0, 0), (8, 0, 0), (11, 0, None), (1, 0, 1), (None, 0, 1)], none.schema)
    got = toxicity.toxicity(docs, few).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), few).count() == 0
