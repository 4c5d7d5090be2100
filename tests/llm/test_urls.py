"""URL filters: parsing and given rules against plain Python, mined rules against counting all combinations."""

import itertools
import re
from collections import Counter

import pytest

from millrace.llm import urls
from millrace.llm.queries import QUERIES

ODD = [
    None, "", "no scheme/here", "http://", "HTTP://A.NET/x", "http://net/", "http://net", "https://www.Example.net/en/1?x=://y",
    "https://example.net/en", "http://notexample.net/en/1", "ftp://x.ORG/fr/a#b", "http://org?/fr/", "http://ÄÖ.org/fr/",
    "http://sub.example.com/de/" + "x" * 70000, "a://b://c.net/d", "http://example.com/\nde/", "://.net/", "http://x.net:80/", "http://u@y.com/de/",
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, tail = re.match(r"([^/?#]*)(.*)", rest, re.DOTALL).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", tail, re.DOTALL)[0]


def given(host, path):
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return (best[0] + best[1], best[2]) if best else (None, None)


def check(rows):
    for r in rows:
        assert (r.host, r.path) == parse(r.url)
        rule, verdict = given(r.host, r.path)
        assert r.rule == rule and r.verdict in ((verdict,) if rule else ("allow", "block"))


def test_query_follows_the_given_rules(spark, sf_dir):
    url = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op12_url_filters"](spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(url)
    for r in rows:
        assert (r.host, r.path) == parse(url[r.page_id]) and r.rule == given(r.host, r.path)[0]
        assert r.verdict == (given(r.host, r.path)[1] or r.verdict) and r.verdict in ("allow", "block")


def expected_rules(rows, support, confidence):
    """All combinations counted one by one."""
    counts = Counter()
    for items, verdict in rows:
        for n in range(1, len(items) + 1):
            for some in itertools.combinations(sorted(items), n):
                counts[some] += 1
                counts[some, verdict] += 1
    return {
        (key[0], key[1]): (n / counts[key[0]], n / len(rows))
        for key, n in counts.items()
        if isinstance(key[0], tuple) and n >= support * len(rows) and n >= confidence * counts[key[0]]
    }


def test_mined_rules_are_those_of_all_combinations(spark):
    rows = [([t for t, d in zip("abcdef", (2, 3, 5, 7, 11, 1), strict=True) if k % d < 1 + d // 3], "block" if k % 5 < 2 else "allow") for k in range(300)]
    labelled = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], "tokens array<string>, verdict string, deal long")
    found = urls.mined(labelled, support=0.02, confidence=0.7)
    got = {(tuple(r["items"]), r["verdict"]): (r["confidence"], r["support"]) for r in found.collect()}
    want = expected_rules(rows, 0.02, 0.7)
    assert got.keys() == want.keys() and len(got) > 5
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_pruned_rules_keep_the_smallest_of_the_sure_ones():
    rules = [(("a",), "block", 0.9, 0.5), (("a", "b"), "block", 0.9, 0.2), (("a", "c"), "block", 0.95, 0.1), (("a", "c"), "allow", 0.8, 0.1), (("b",), "block", 0.8, 0.4)]
    assert urls.pruned(rules) == [rules[2], rules[0], rules[4], rules[3]]


def test_index_finds_the_first_rule_that_holds():
    rules = [(tuple(sorted(s)), "block", 1 - k / 100, 0.1) for k, s in enumerate(["abc", "de", "a", "bd", "xyz", "c"])]
    index = urls.index_of(rules)
    for n in range(6):
        for own in itertools.combinations("abcdexyz", n):
            want = next((k for k, r in enumerate(rules) if {*r[0]} <= {*own}), None)
            assert urls.first_rule(own, index) == want


def test_odd_rows_and_clashing_names(spark):
    rows = [(k, u, "h", "v", 1) for k, u in enumerate([*ODD, *ODD[4:8]])]
    docs = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, n int")
    found = urls.judged(docs).collect()
    assert sorted(r.page_id for r in found) == sorted(r[0] for r in rows)
    check(found)
    assert all(r.verdict == "allow" for r in found if r.url is None)


def test_learned_rules_decide_other_urls(spark):
    rows = [f"http://bets{k}.a.net/x" for k in range(30)] + [f"http://good{k}.b.org/fr/{k}" for k in range(30)]
    rows += ["http://bets7.com/1", "http://good8.com/1", "http://other.com/1"]
    found = {r.url: r for r in urls.judged(spark.createDataFrame([(u,) for u in rows], "url string")).collect()}
    assert found["http://bets7.com/1"].verdict == "block" and found["http://bets7.com/1"].learned
    assert found["http://good8.com/1"].verdict == "allow" and found["http://good8.com/1"].learned
    assert found["http://other.com/1"].verdict == "allow" and found["http://other.com/1"].learned is None


def test_no_rows_and_no_labels(spark):
    assert urls.judged(spark.createDataFrame([], "url string")).count() == 0
    assert [r.verdict for r in urls.judged(spark.createDataFrame([("http://a.com/x",)], "url string")).collect()] == ["allow"]


def test_all_tokens_of_a_url_are_mined(spark):
    """Ten tokens a row, of which no eight hold all combinations."""
    names = "abcdefghij"
    rows = [([t for n, t in enumerate(names) if (k * 7 + n * n) % 11], "block" if k % 11 != 8 else "allow") for k in range(60)]
    labelled = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], "tokens array<string>, verdict string, deal long")
    got = {(tuple(r["items"]), r["verdict"]) for r in urls.mined(labelled, support=0.05, confidence=0.7).collect()}
    assert got == expected_rules(rows, 0.05, 0.7).keys() and any(len(i) > 8 for i, _ in got)


def test_rules_over_kinds_are_those_of_all_combinations(spark):
    """Tokens that come together, alone or with one verdict: rules, fit and order as from all combinations of all tokens."""
    rows = []
    for k in range(240):
        items = {t for t, d in zip("cfadg", (2, 3, 5, 7, 4), strict=True) if k % d < 1 + d // 3}
        items |= {"b"} if "c" in items else set()  # the same rows as c
        items |= {"p", "q"} if k % 8 == 3 else set()
        rows.append((sorted(items), "allow" if items >= {"p"} or items >= {"a", "c"} or k % 10 > 6 else "block"))
    labelled = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], "tokens array<string>, verdict string, deal long")
    kind, order = urls.learned_rules(labelled, 0.02, 0.7)
    assert kind["c"] == kind["b"] == "b" and kind["q"] == kind["p"] == "p"
    brute = urls.pruned([(i, v, *f) for (i, v), f in expected_rules(rows, 0.02, 0.7).items()])
    assert {("p",), ("a", "b")} <= {i for i, *_ in order}
    index, want = urls.index_of(order), urls.index_of(brute)
    for n in range(9):
        for own in itertools.combinations("abcdfgpq", n):
            got, one = urls.first_rule({kind[t] for t in own if t in kind}, index), urls.first_rule(own, want)
            assert (got is None) == (one is None)
            assert got is None or order[got][1:] == pytest.approx(brute[one][1:])


def test_a_token_beyond_the_eight_surest_decides(spark):
    rows = [f"http://w{k}.a.b.c.d.e.net/promo/x" for k in range(20)] + [f"http://v{k}.org/fr/y" for k in range(20)]
    found = {r.url: r for r in urls.judged(spark.createDataFrame([(u,) for u in [*rows, "http://z.com/promo/x"]], "url string")).collect()}
    assert found["http://z.com/promo/x"].verdict == "block" and found["http://z.com/promo/x"].learned == ["folder:promo"]


def test_many_tokens_that_come_together_are_mined_as_one(spark):
    """Forty tokens a URL with both verdicts, which have 2 ** 40 combinations."""
    host = ".".join(f"h{chr(97 + k)}" for k in range(20))
    rows = [f"http://{host}.n{k}.net/x" for k in range(45)] + [f"http://{host}.org/fr/{k}" for k in range(5)] + [f"http://o{k}.org/fr/" for k in range(20)]
    found = {r.url: r for r in urls.judged(spark.createDataFrame([(u,) for u in [*rows, "http://hc.hb.com/"]], "url string")).collect()}
    assert found["http://hc.hb.com/"].verdict == "block" and found["http://hc.hb.com/"].learned == ["label:hb"]
