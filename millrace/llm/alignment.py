"""Alignment of two tokenizers' tokens by the bytes they cover, as Arrow tables from the ids to the counts.

Each batch's token lists are flattened, with the number of their document as parent;
a cumulative sum of byte lengths within the document gives every token's end; hash
joins on document and end find where both tokenizers end a token. Pair counts are
grouped within the task first and then merged by Spark.

A pair of ids can only be linked if the bytes of one end in the bytes of the other,
since both cover the same text up to the same end. So there are at most as many
different pairs as both vocabularies have bytes, however large the corpus is, and the
table of counts is sent to all tasks.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.buffers import pieces, text_bytes
from millrace.llm.tokens import Memory, joined
from millrace.session import cut

#: Bytes of text in work at a time; a longer text is a run alone.
RUN_BYTES = 1 << 20
#: Different pairs that a task sums up before it hands them on.
HELD_PAIRS = 1 << 18

Encode = Callable[[list[str]], list[list[int]]]


def _byte_of_mark() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it prints, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def byte_level(path: str) -> tuple[Encode, list[bytes]]:
    """Encoder of a byte-level vocabulary file, which gets a space before each text, and the bytes of its tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    from tokenizers import Tokenizer

    tokenizer, byte = Tokenizer.from_file(path), _byte_of_mark()
    tokenizer.encode_special_tokens = True
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    table = [bytes(byte[c] for c in n) if all(c in byte for c in n) else n.encode() for n in names]
    encode = lambda texts: [x.ids for x in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    return encode, table


@functools.cache
def piece_level(path: str) -> tuple[Encode, list[bytes]]:
    """Encoder of a piece model, which adds the space itself, and the bytes of its pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    table = [
        bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()
        for i, name in enumerate(map(model.id_to_piece, range(size)))
    ]
    return lambda texts: model.encode(texts, num_threads=1), table


class _Side:
    """One tokenizer with what a task needs of its tokens: length, bytes and number as text."""

    def __init__(self, encode: Encode, table: list[bytes]):
        self.bytes = pa.array(table, pa.large_binary())
        self.length = pc.binary_length(self.bytes)
        self.number = pa.array([str(i) for i in range(len(table))], pa.large_string())
        self.memory = Memory(encode)
        #: No token has a space after a byte that texts are parted behind, so none reaches over a cut.
        self.parts = not any(re.search(rb"([!-~]|(^|[\xc3-\xdf])[\x80-\xbf]) ", t) for t in table)


@functools.cache
def _sides(byte_path: str, piece_path: str) -> tuple[_Side, _Side]:
    return _Side(*byte_level(byte_path)), _Side(*piece_level(piece_path))


def _parted(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts in parts that are encoded alike alone, and the number of parts up to each text.

    Cut at each single space between two characters that are no white space by anyone's
    rule: printable ASCII ones, or those from U+00C0 to U+07FF. There the byte-level
    pattern begins anew, and no piece reaches over it; the space itself goes, since both
    tokenizers put one before each part.
    """
    printable = (data > 0x20) & (data < 0x7F)
    two = (data >= 0xC3) & (data <= 0xDF)  # first bytes of two
    after = np.concatenate([[False, False], two[:-2]])[: len(data)] | np.concatenate([[False], printable[:-1]])[: len(data)]
    at = np.flatnonzero((data == 0x20) & after & np.concatenate([(printable | two)[1:], [False]])[: len(data)])
    text = np.searchsorted(starts, at, side="right") - 1
    at = at[(at > starts[text] + (~printable[at - 1]).astype(np.int64)) & (at + 1 < starts[text + 1])]  # neighbours of the same text
    kept = np.delete(data, at)
    some = starts[:-1][np.diff(starts) > 0]
    begins = np.sort(np.concatenate([some, at + 1]))
    offsets = np.concatenate([begins - np.searchsorted(at, begins), [len(kept)]]).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return parts, np.searchsorted(begins, starts)


def _encoded(sides: tuple[_Side, _Side], texts: pa.Array) -> list[pa.LargeListArray]:
    """Token ids of each text by each tokenizer; each different part is encoded once."""
    data, starts = text_bytes(texts)
    if all(s.parts for s in sides):
        parts, upto = _parted(data, starts)
    else:
        full = np.diff(starts) > 0
        parts, upto = texts.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])
    named = parts.dictionary_encode()
    index, names = named.indices.to_numpy(zero_copy_only=False), named.dictionary.to_pylist()
    out = []
    for side in sides:
        flat, total = joined(side.memory.ids(names), index)
        out.append(pa.LargeListArray.from_arrays(pa.array(total[upto]), pa.array(flat.astype(np.int32))))
    return out


def _tokens(side: _Side, lists: pa.LargeListArray, stride: int) -> pa.Table:
    """``id, key, row`` of every token; the key is its document and the byte that it ends before."""
    ids, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    ends = pc.cumulative_sum(side.length.take(ids).cast(pa.int64()))
    before = np.concatenate([[0], ends.to_numpy()])[lists.offsets.to_numpy()]  # of all earlier documents
    end = pc.subtract(ends, pa.array(before[:-1]).take(parent))
    key = pc.add(pc.multiply(parent.cast(pa.int64()), stride), end)
    return pa.table({"id": ids, "key": key, "row": pa.array(np.arange(len(ids)))})


def _covering(sides: tuple[_Side, _Side], lists: list[pa.LargeListArray], texts: pa.Array) -> np.ndarray:
    """Of which documents both tokenizers give back every byte."""
    raw, at = text_bytes(texts)
    raw, good = memoryview(raw), np.diff(at) > 0
    for side, found in zip(sides, lists, strict=True):
        data = side.bytes.take(pc.list_flatten(found))
        starts = np.frombuffer(data.buffers()[1], np.int64)[: len(data) + 1][found.offsets.to_numpy() - found.offsets[0].as_py()]
        whole = memoryview(data.buffers()[2] or b"").cast("B")
        for k in np.flatnonzero(good).tolist():
            own = whole[starts[k] : starts[k + 1]]
            good[k] = own[:1] == b" " and own[1:] == raw[at[k] : at[k + 1]]
    return good


def _only(lists: pa.LargeListArray, keep: np.ndarray) -> pa.LargeListArray:
    """The lists, empty where they are not kept."""
    return pc.if_else(pa.array(keep), lists, pa.scalar([], lists.type)) if not keep.all() else lists


def _digests(sides, tables, groups: list[np.ndarray], docs: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups as text, '' where it has none; ``docs``: first group of each document."""
    a, b = groups
    total = int(docs[-1])
    count_a, count_b = np.bincount(a, minlength=total), np.bincount(b, minlength=total)
    upto_a, upto_b = np.cumsum(count_a), np.cumsum(count_b)
    place_a = np.arange(len(a)) + (upto_b - count_b)[a]
    place_b = np.arange(len(b)) + upto_a[b]
    numbers = pa.concat_arrays([s.number.take(t["id"].combine_chunks()) for s, t in zip(sides, tables, strict=True)])
    order = np.empty(len(a) + len(b), np.int64)
    order[place_a], order[place_b] = np.arange(len(a)), len(a) + np.arange(len(b))
    mark = np.zeros(len(order), np.int8)
    mark[(upto_a + upto_b - count_b - 1)[count_a > 0]] = 1
    mark[(upto_a + upto_b - 1)] = 2
    marks = pa.array([",", "|", ";"], pa.large_string()).take(pa.array(mark))
    line = pc.binary_join_element_wise(numbers.take(pa.array(order)), marks, pa.scalar("", pa.large_string()))
    starts = np.frombuffer(line.buffers()[1], np.int64)[: len(line) + 1]
    whole = memoryview(line.buffers()[2] or b"").cast("B")
    at = starts[np.concatenate([[0], upto_a + upto_b])[docs]]
    return [hashlib.sha256(whole[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _summed(table: pa.Table, *key: str) -> pa.Table:
    """``n`` summed up by key."""
    out = table.group_by([*key], use_threads=False).aggregate([("n", "sum")])
    return out.rename_columns([*key, "n"])


def _aligned(batch: pa.RecordBatch, sides: tuple[_Side, _Side], run: int) -> Iterator[pa.RecordBatch]:
    filled = batch["text"].cast(pa.large_string()).fill_null("")
    _, starts = text_bytes(filled)
    for first, last in pieces(starts, run):
        texts = filled.slice(first, last - first)
        lists = _encoded(sides, texts)
        good = _covering(sides, lists, texts)
        lists = [_only(found, good) for found in lists]
        stride = int(np.diff(starts[first : last + 1]).max(initial=0)) + 2
        tables = [_tokens(s, found, stride) for s, found in zip(sides, lists, strict=True)]
        links = tables[0].rename_columns(["a", "key", "row_a"]).join(
            tables[1].rename_columns(["b", "key", "row_b"]), "key", join_type="inner", use_threads=False
        )
        links = links.combine_chunks()
        key = links["key"].to_numpy()
        both = np.zeros(len(tables[0]), bool)
        both[links["row_a"].to_numpy()] = True
        ends = tables[0]["key"].to_numpy()[both]  # in order, since the tokens are
        ends = ends[np.diff(ends, prepend=-1) > 0]
        doc = np.arange(len(texts) + 1) * stride
        groups = [np.searchsorted(ends, t["key"].to_numpy()) for t in tables]
        upto = np.searchsorted(ends, doc)
        pairs = pa.table({"doc": pa.array(key // stride), "a": links["a"], "b": links["b"], "n": pa.array(np.ones(len(key), np.int64))})
        pairs = _summed(pairs, "doc", "a", "b").sort_by("doc").combine_chunks()
        of_doc = pa.array(np.searchsorted(pairs["doc"].to_numpy(), np.arange(len(texts) + 1)).astype(np.int32))
        listed = lambda name: pa.ListArray.from_arrays(of_doc, pairs[name].combine_chunks())
        yield pa.record_batch(
            {
                "doc_id": batch["doc_id"].slice(first, last - first),
                "n_a": pa.array(np.diff(lists[0].offsets.to_numpy())), "n_b": pa.array(np.diff(lists[1].offsets.to_numpy())),
                "n_groups": pa.array(np.diff(upto)), "n_links": pa.array(np.bincount(key // stride, minlength=len(texts))),
                "groups_sha256": pa.array(_digests(sides, tables, groups, upto), pa.string()),
                "a": listed("a"), "b": listed("b"), "n": listed("n"),
            }
        )


_FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<long>"


def alignments(docs: DataFrame, byte_path: str, piece_path: str, run: int = RUN_BYTES) -> DataFrame:
    """Each document's counts and digest, and its linked id pairs with how often it links them (``a``, ``b``, ``n``)."""

    def align(batches):
        sides = _sides(byte_path, piece_path)
        for batch in batches:
            yield from _aligned(batch, sides, run)

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return typed.mapInArrow(align, _FOUND)


def _partial(batches):
    held = []

    def summed():
        out = _summed(pa.concat_tables(held), "a", "b")
        held.clear()
        return out

    for batch in batches:
        held.append(pa.table({n: pc.list_flatten(batch[n]) for n in ("a", "b", "n")}))
        if sum(t.num_rows for t in held) > HELD_PAIRS:
            held.append(summed())
            if held[0].num_rows > HELD_PAIRS // 2:
                yield from held.pop().to_batches()
    if held:
        yield from summed().to_batches()


def pair_counts(found: DataFrame) -> DataFrame:
    """``a, b, n``: how many links of all documents of ``alignments`` hold each id pair linked. No documents give no rows."""
    partial = found.select("a", "b", "n").mapInArrow(_partial, "a int, b int, n long")
    return partial.groupBy("a", "b").agg(F.sum("n").alias("n"))


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``. Byte ends
    that both tokenizers share cut a document's tokens into groups; a link is a token of
    each that end together. ``n_best`` counts the links whose pair no other pair of the
    same second id exceeds in the whole corpus, ``count_sum`` adds up their pairs' counts.

    A null or empty text, or one that a tokenizer's bytes do not give back, has no
    tokens: zeros and an empty digest, and it counts for no pair. Rows that repeat an id
    or a text are rows each and count each; a null doc_id stays null. No rows give no
    rows. Other columns are not read. A text's tokens are in memory together, about 50
    bytes for each.
    """
    found = cut(alignments(docs, byte_path, piece_path), "alignment")
    counts = pair_counts(found).toArrow()  # bounded by the vocabularies, see above
    pair = counts["a"].to_numpy().astype(np.int64) << 32 | counts["b"].to_numpy()
    order = np.argsort(pair)
    pair, n, b = pair[order], counts["n"].to_numpy()[order], counts["b"].to_numpy()[order]
    most = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, b, n)
    sent = docs.sparkSession.sparkContext.broadcast((pair, n, n == most[b]))
    plain = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def weighed(batches):
        pair, n, best = sent.value
        for batch in batches:
            upto = batch["a"].offsets.to_numpy()
            a, b, own = (pc.list_flatten(batch[x]).to_numpy() for x in ("a", "b", "n"))
            at = np.searchsorted(pair, a.astype(np.int64) << 32 | b)
            of = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[upto - upto[0]])
            columns = {x: batch[x] for x in plain}
            columns |= {"n_best": pa.array(of(own * best[at])), "count_sum": pa.array(of(own * n[at]))}
            yield pa.record_batch(columns)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return found.mapInArrow(weighed, schema)
