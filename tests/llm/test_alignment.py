"""Token alignment against plain Python, one document at a time."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment
from millrace.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, QUERIES
from tests.llm.fixtures import odd_documents

EXTRA = [
    (20, "ends in a space ", "en", "s3"), (21, "<|endoftext|> <s> </s> <0x41> <unk> ▁ kept apart", "en", "s3"),
    (22, "tabs\tand\r\nlines    and  three   blanks ½ ﬁ ① ́x", "en", "s3"), (23, " ", "en", "s3"),
    (24, "plain words only. " * 3000 + "it's  1234 we'RE é ç", "en", "s3"), (25, "\x00 nul \x1c \U0001f468‍\U0001f469", "en", "s3"),
]


def plain(rows):
    a_model = Tokenizer.from_file(BYTE_TOKENIZER)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECE_TOKENIZER)
    byte = alignment._byte_of_mark()
    docs, counts = [], Counter()
    for doc, text in rows:
        text = text or ""
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            docs.append((doc, [], [], [], []))
            continue
        ends_a, ends_b, at = [], [], 0
        for t in a_bytes:
            ends_a.append(at := at + len(t))
        at = 0
        for t in b_bytes:
            ends_b.append(at := at + len(t))
        groups = [([], []) for _ in {*ends_a} & {*ends_b}]
        for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
            common, k = sorted({*ends_a} & {*ends_b}), 0
            for i, end in zip(ids, ends, strict=True):
                while common[k] < end:
                    k += 1
                groups[k][side].append(i)
        of_end = dict(zip(ends_b, b, strict=True))
        links = [(i, of_end[e]) for i, e in zip(a, ends_a, strict=True) if e in of_end]
        counts.update(links)
        docs.append((doc, a, b, groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc, a, b, groups, links in docs:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if a else ""
        best = sum(counts[p] == most[p[1]] for p in links)
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return sorted(out, key=repr)


def found(df):
    order = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r) for r in df.select(*order).collect()), key=repr)


def test_alignment_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(QUERIES["op11_token_alignment"](spark, sf_dir)) == plain(rows)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark, EXTRA).persist()


def test_alignment_of_odd_rows(odd):
    want = plain([(r.doc_id, r.text) for r in odd.collect()])
    assert found(alignment.aligned(odd, BYTE_TOKENIZER, PIECE_TOKENIZER)) == want
    assert sum(r[1] > 0 for r in want) > 10 and any(r[0] == 21 and r[1] == 0 for r in want)


def test_alignment_in_small_runs(odd):
    whole = alignment.alignments(odd, BYTE_TOKENIZER, PIECE_TOKENIZER).drop("a", "b", "n")
    small = alignment.alignments(odd, BYTE_TOKENIZER, PIECE_TOKENIZER, run=64).drop("a", "b", "n")
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, small.collect()))


def test_parts_are_encoded_as_in_their_text():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    marks = ["a", "Z", "é", "\u07ff", "\u00a0", "\u0085", "\u2003", "▁", "日", "\U0001f600", "'s", "'", ".", "7", "\n", "\t", "\x1c", "\x00", " ", " ", " ", " "]
    texts = ["".join(rng.choice(marks, rng.integers(0, 40))) for _ in range(3000)]
    sides = alignment._sides(BYTE_TOKENIZER, PIECE_TOKENIZER)
    assert all(s.parts for s in sides)
    for side, found in zip(sides, alignment._encoded(sides, pa.array(texts, pa.large_string())), strict=True):
        assert found.to_pylist() == [side.memory.encode([t])[0] if t else [] for t in texts]


def test_partial_pair_counts_add_up(odd, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 4)
    batches = list(alignment._partial(b for b in pairs_of(3)))
    total = Counter()
    for batch in batches:
        for r in batch.to_pylist():
            total[r["a"], r["b"]] += r["n"]
    assert total == {(k, k + 1): 6 for k in range(10)}


def pairs_of(times):
    import pyarrow as pa

    for _ in range(times):
        k = [*range(10)]
        yield pa.record_batch({"a": pa.array([k], pa.list_(pa.int32())), "b": pa.array([[x + 1 for x in k]], pa.list_(pa.int32())), "n": pa.array([[2] * 10], pa.list_(pa.int64()))})


def test_alignment_of_no_rows(odd):
    assert alignment.aligned(odd.limit(0), BYTE_TOKENIZER, PIECE_TOKENIZER).count() == 0
