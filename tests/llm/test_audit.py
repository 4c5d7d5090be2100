"""Filter audit against plain Python over all orders, with rows that arrive in an order that makes earlier ones copies."""

import itertools
import re
from collections import Counter, defaultdict

import pytest

from millrace.llm import audit
from millrace.llm.queries import QUERIES
from tests.llm.fixtures import odd_documents


def fails(rows):
    """Filters that each row (doc_id, text, source) fails, as a set of letters."""
    least = {}
    for doc, text, _ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append(
            {
                name
                for name, bad in (
                    ("A", len(words) < 200), ("B", 100 * len({*words}) < 50 * len(words)),
                    ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text))),
                    ("E", doc is not None and doc > least[text]),
                )
                if bad
            }
        )
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    of_part = defaultdict(list)
    for row, failed in zip(rows, fails(rows), strict=True):
        of_part[row[2] or ""].append((row[0], failed))
    out = []
    for part, docs in of_part.items():
        shapley, mine = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, name in enumerate(order, 1):
                removed = [d for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                redundant = sum(name in f for _, f in docs) - len(removed)
                alone = sum(f == {name} for _, f in docs)
                shapley[name] += len(removed)
                lost = [sum(d in marked for d in removed) for marked in (good, toxic)]
                mine.append((part, order, step, len(left), len(removed), redundant, alone, *lost))
        out += [(*m, shapley[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


def found(df):
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labels") / "labels")
    rows = [(1, 1, 0), (2, 0, 1), (4, None, None), (4, 1, 1), (11, 1, 0), (None, 1, 1), (70, 1, 1), (5, 0, 1)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(path)
    return path, rows


def test_audit_query(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert found(QUERIES["op13_filter_audit"](spark, sf_dir)) == brute(rows, labels)


EXTRA = [(k, ["Same # words " * 90, "one", "", "Another TEXT " + "w " * 300][k % 4], "en", f"s{k % 3}") for k in range(40, 100)]


@pytest.mark.parametrize("descending", [False, True])
def test_smaller_ids_that_come_later_take_counts_back(spark, labels, tmp_path, descending):
    docs = odd_documents(spark, EXTRA)
    path = str(tmp_path / "documents")
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id or 0), reverse=descending)
    for first in range(0, len(rows), 20):
        spark.createDataFrame(rows[first : first + 20], docs.schema).coalesce(1).write.mode("append").parquet(path)
    counted = audit.counters(spark, path, labels[0], batches=100)
    want = [(r.doc_id, r.text, r.source) for r in rows]
    assert found(audit.interactions(counted)) == brute(want, labels[1])


def test_moves_of_a_text(spark):
    empty = spark.createDataFrame([], f"text_key binary, doc_id long, {audit.CHANGES}")

    def step(state, *some):
        rows = spark.createDataFrame([(b"k", *r) for r in some], audit._PARTIAL)
        moved = audit.moves(rows, state)
        added = moved.where("first").select("text_key", "doc_id", "part", "mask", "good", "toxic", "n")
        return state.union(added), sorted(tuple(r) for r in moved.select("part", "mask", "good", "toxic", "n").collect())

    state, got = step(empty, (1, 9, "p", 1, 0, 0, 2), (0, 0, "p", 1, 0, 0, 3))
    assert got == [("p", 1, 0, 0, 2), ("p", 1, 0, 0, 3)]
    state, got = step(state, (1, 12, "q", 1, 1, 0, 1), (2, 0, "q", 1, 0, 0, 4))
    assert got == [("q", 17, 0, 0, 4), ("q", 17, 1, 0, 1)]
    state, got = step(state, (1, 7, "q", 1, 0, 1, 1))
    assert got == [("p", 1, 0, 0, -2), ("p", 17, 0, 0, 2), ("q", 1, 0, 1, 1)]
    state, got = step(state, (1, 7, "p", 1, 0, 1, 1), (1, 9, "p", 1, 0, 0, 1))
    assert got == [("p", 1, 0, 1, 1), ("p", 17, 0, 0, 1)]
    assert step(state, (1, 3, "p", 1, 0, 1, 1))[1] == [
        ("p", 1, 0, 1, -1), ("p", 1, 0, 1, 1), ("p", 17, 0, 1, 1), ("q", 1, 0, 1, -1), ("q", 17, 0, 1, 1)
    ]


def test_audit_of_no_rows(spark, labels, tmp_path):
    path = str(tmp_path / "documents")
    odd_documents(spark).limit(0).write.parquet(path)
    assert audit.audit(spark, path, labels[0]).count() == 0
