import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import dedup
from millrace.llm.components import components
from millrace.llm.queries import QUERIES
from millrace.llm.streams import fixed_binary
from tests.llm.fixtures import odd_documents, shingle_set


def brute(rows):
    """Components over (doc_id, text) rows by comparing all pairs that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                head[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_query_agrees_with_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op6_near_duplicates"](spark, sf_dir)) == brute(rows)


def test_large_group_is_compared_in_blocks(spark, monkeypatch):
    """Copies with more and more changes, in blocks of a few: no link between blocks is lost."""
    monkeypatch.setattr(dedup, "GROUP_BLOCK", 8)
    monkeypatch.setattr(dedup, "BUCKET_BLOCK", 16)
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        text = list(base)
        for at in rnd.sample(range(120), rnd.randrange(12)):
            text[at] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(dedup.near_duplicates(df)) == brute(rows)


def test_odd_rows(spark):
    df = odd_documents(spark)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert got(dedup.near_duplicates(df)) == brute(rows)
    kept = dedup.deduplicated(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(11) == 1 and ids.count(10) == 1 and 7 not in ids and 5 not in ids and {1, 2, 3, 4, 6, 8, 9} <= set(ids)


def test_pairs_with_unlucky_sketches_are_linked(spark):
    """Of pairs at the threshold that share a table, those with the fewest equal minhashes."""
    texts = [" ".join(f"p{k}x{i}" for i in range(d, d + 60)) for k in range(6000) for d in (0, 8)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    signed = pa.Table.from_batches(dedup._signatures([batch]))
    sketch, halves = (fixed_binary(signed[c], kind) for c, kind in (("sketch", np.uint8), ("halves", np.uint64)))
    same = halves[::2] == halves[1::2]
    shared = same[:, : dedup.HALVES].any(axis=1) & same[:, dedup.HALVES :].any(axis=1)
    unlucky = np.flatnonzero(shared & ((sketch[::2] == sketch[1::2]).sum(axis=1) < 27))
    assert len(unlucky)
    rows = [(int(2 * k + d), texts[2 * k + d]) for k in unlucky for d in (0, 1)]
    assert got(dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_survivors_are_chosen_by_their_own_text(spark):
    """Null-id rows are documents of their own; a copy never stands in for another text of its doc_id."""
    word = lambda n, k: " ".join(f"{n}{i}" for i in range(k))
    rows = [
        (None, word("a", 9)), (None, word("b", 9)), (None, word("b", 9)), (None, ""), (None, None), (None, word("c", 9)),
        (1, word("c", 9)), (2, word("d", 9)), (3, word("e", 9)), (3, word("d", 9)), (4, word("d", 9)), (4, word("f", 9)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [rows[k] for k in (0, 1, 3, 4, 6, 7, 8, 11)]
    assert sorted(map(tuple, dedup.deduplicated(df).collect()), key=repr) == sorted(want, key=repr)


def test_rows_without_an_id_or_with_one_id_link_others(spark):
    """Near copies are joined through a null-id row, and where every text has the same doc_id."""
    text = lambda cut: " ".join(f"w{i}" for i in range(cut, cut + 60))
    for ids in ((1, None, 2), (None, None, None), (5, 5, 5)):
        rows = list(zip(ids, map(text, (0, 7, 14)), strict=True))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert got(dedup.near_duplicates(df)) == brute(rows)
        assert dedup.deduplicated(df).count() == 1


def test_empty_table(spark):
    df = odd_documents(spark).limit(0)
    assert dedup.near_duplicates(df).count() == 0
    assert dedup.deduplicated(df).columns == df.columns


def test_components_of_chain_and_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_words_that_cancel_in_powers_of_any_base_are_not_copies(spark):
    one, other = "a", "b"
    for _ in range(10):  # the sequence in which each half is the other one's complement
        one, other = one + other, other + one
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert all(r.kept for r in dedup.near_duplicates(docs).collect())


def test_links_of_a_task_are_joined_before_the_first_round(spark, monkeypatch):
    """A chain in one task needs one round; links dealt at random end in the same components, a few held at a time."""
    from millrace.llm import components as module

    rounds = []
    keep = module.saved
    monkeypatch.setattr(module, "saved", lambda df: rounds.append(1) or keep(df))
    chain = spark.range(0, 3000, 1, 1).select((F.col("id") * 7).alias("a"), (F.col("id") * 7 + 7).alias("b"))
    found = components(chain)
    assert found.count() == 3001 and found.where("component <> 0").count() == 0 and len(rounds) <= 2
    monkeypatch.setattr(module, "HELD", 5)
    rnd = random.Random(8)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(-(2**62), 299), (2**62, 2**62 - 1)]
    head = {n: n for pair in links for n in pair}
    for _ in links:
        for a, b in links:
            head[a] = head[b] = min(head[a], head[b])
    want = {n: h for n, h in head.items() if any(n in p and p[0] != p[1] for p in links)}
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    assert {r.node: r.component for r in components(df).collect()} == want


def test_filter_of_members_is_read_in_one_job(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.format_string("a%d b c d e f%d", "id", "id").alias("text"))
    context = spark.sparkContext
    context.setJobGroup("members", "")
    kept = dedup._members_only(docs, docs.repartition(16, "doc_id").where("doc_id < 300"))
    context.setJobGroup("others", "")
    assert len(context.statusTracker().getJobIdsForGroup("members")) <= 3
    assert {r.doc_id for r in kept.collect()} >= set(range(300))


def test_links_that_meet_in_no_task_are_joined(spark):
    """Each node in a task of its own: 4 and 5 are joined through 3, which is neither's smallest end."""
    links = [(4, 3), (4, 1), (5, 3), (5, 2)]
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == dict.fromkeys(range(1, 6), 1)


def test_links_of_a_node_are_joined_beyond_what_is_held(monkeypatch):
    from millrace.llm import components as module

    monkeypatch.setattr(module, "HELD", 2)
    links = [(9, 1), (9, 2), (9, 3), (9, 4), (10, 4), (11, 12)]
    batches = [pa.record_batch({"a": pa.array([a]), "b": pa.array([b])}) for a, b in links]
    found = [(r["a"], r["b"]) for part in module._shortened([batches[0].slice(1), *batches]) for r in part.to_pylist()]
    head = {n: n for link in links for n in link}
    for _ in links:
        for a, b in found:
            head[a] = head[b] = min(head[a], head[b])
    assert head == dict.fromkeys((1, 2, 3, 4, 9, 10), 1) | {11: 11, 12: 11}


def test_stars_of_blocks_need_no_rounds(spark, monkeypatch):
    """Only rough groups, and what is left in parts, are joined in rounds."""
    monkeypatch.setattr(dedup, "GROUP_BLOCK", 8)
    rounds = []
    keep = dedup.stars
    monkeypatch.setattr(dedup, "stars", lambda links: rounds.append(1) or keep(links))
    rows = [(k, " ".join(f"x{k}" if i == 7 * (k % 9) else f"w{i}" for i in range(90)) + f" y{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(dedup.near_duplicates(df)) == brute(rows) and len(rounds) == 1
