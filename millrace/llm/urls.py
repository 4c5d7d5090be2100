"""URL filters: given rules first, and for other URLs association rules mined from those that the given rules label.

A URL's tokens are its host labels, the words in them, and its path's folders and
file ending, with digits written as 0. FP-growth over the tokens and the verdict of
labelled URLs finds combinations that mostly go with one verdict. Rules are kept by
support and confidence, and only if no smaller combination is as sure. All labelled
URLs and all their tokens count; what no combination can change is left out of the
mining: tokens that the same URLs have are one, and those of one verdict are rules
by themselves. An inverted index from a rule's rarest token to the rule finds those
that a URL fulfils.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.streams import saved

# Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCK, ALLOW = "block", "allow"
#: Share of the labelled URLs that a rule's combination has at least, and of its URLs that have its verdict.
SUPPORT = 0.002
CONFIDENCE = 0.8


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``: the host with A-Z lower-cased, both '' where there is no ``://``."""
    rest = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns({"host": F.translate(host, upper, lower), "path": path})


def _fitting(rules: Sequence[tuple[str, str, str]]) -> F.Column:
    """The longest rule that fits ``host`` and ``path``, as ``(rule, verdict)``, or null; of equally long ones the first."""
    found = F.lit(None)
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a later one goes first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(host: F.Column, path: F.Column) -> F.Column:
    """Distinct tokens of a URL, each with what it is a part of. Digits are 0, so numbered pages are alike."""
    same = lambda c: F.regexp_replace(c, r"[0-9]+", "0")
    host, path = same(host), same(path)
    labels = F.split(host, r"\.")
    words = F.filter(F.split(host, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    folders = F.filter(F.split(F.regexp_replace(path, r"[^/]*$", ""), "/"), lambda w: w != "")
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    named = lambda kind, items: F.transform(items, lambda w: F.concat(F.lit(kind + ":"), w))
    all_ = F.concat(
        named("label", F.filter(labels, lambda w: w != "")), named("word", words), named("folder", folders),
        named("ending", F.filter(F.array(ending), lambda w: w != "")),
    )
    return F.array_distinct(all_)


def kinds(labelled: DataFrame, support: float = SUPPORT) -> tuple[dict[str, str], list[tuple[tuple[str, ...], str, float, float]]]:
    """What needs no mining of combinations: tokens of a kind, and rules of one token that never fail.

    From ``labelled(tokens, verdict, deal)``, rows of one ``deal`` being alike. Tokens that
    exactly the same rows have are of one kind, named by the least of them: in a combination
    any can stand for the others, and two of them say no more than one. A kind that only one
    verdict has is a rule, and nothing with more tokens is surer. Returned are the kind of
    each token that enough rows of a verdict have, at most tokens a row / ``support`` of
    them, and those rules.
    """
    part = lambda seed: F.sum(F.pmod(F.xxhash64("deal", F.lit(seed)), F.lit(1 << 31)))
    flat = labelled.select(F.explode("tokens").alias("token"), (F.col("verdict") == BLOCK).cast("long").alias("bad"), "deal")
    tallied = flat.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), part(1).alias("one"), part(2).alias("two"))
    total = labelled.count()
    enough = tallied.where(F.greatest(F.col("bad"), F.col("n") - F.col("bad")) >= F.lit(math.ceil(support * total)))
    kind, least, never = {}, {}, []
    for r in sorted(enough.toLocalIterator(), key=lambda r: r.token):
        rows = (r.n, r.bad, r.one, r.two)
        if rows not in least and r.bad in (0, r.n):
            never.append(((r.token,), BLOCK if r.bad else ALLOW, 1.0, r.n / total))
        kind[r.token] = least.setdefault(rows, r.token)
    return kind, never


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules ``items, verdict, confidence, support`` from ``labelled(tokens, verdict)``: all rows and tokens are mined.

    No rows, or no combination with enough support, give no rules.
    """
    marked = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    model = FPGrowth(minSupport=support, minConfidence=confidence, itemsCol="items").fit(marked)
    found = model.associationRules.where(F.col("consequent")[0].startswith("verdict=")).where(
        ~F.exists("antecedent", lambda t: t.startswith("verdict="))
    )
    return found.select(
        F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 9, 100).alias("verdict"),
        "confidence", "support",
    )


def needed(rules: DataFrame) -> DataFrame:
    """``rules`` of ``mined`` without those that are no surer than one with a token less; what is left is for ``pruned``."""
    smaller = rules.select(
        "verdict", F.col("items").alias("whole"), F.col("confidence").alias("own"),
        F.explode(F.transform("items", lambda t: F.array_remove("items", t))).alias("items"),
    )
    needless = smaller.join(rules, ["items", "verdict"]).where("confidence >= own").select(F.col("whole").alias("items"), "verdict")
    return rules.join(needless.distinct(), ["items", "verdict"], "left_anti")


def learned_rules(
    labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE
) -> tuple[dict[str, str], list[tuple[tuple[str, ...], str, float, float]]]:
    """The kind of each token, and the rules over kinds in the order in which they decide.

    Combinations are mined over the kinds that both verdicts have. With any token of a
    kind for its name, the rules are those of all combinations of all tokens.
    """
    kind, never = kinds(labelled, support)
    apart = {items[0] for items, *_ in never}
    sent = labelled.sparkSession.sparkContext.broadcast({t: k for t, k in kind.items() if k not in apart})

    @F.pandas_udf("array<string>")
    def open_kinds(column: pd.Series) -> pd.Series:
        known = sent.value
        return column.map(lambda items: sorted({known[t] for t in items if t in known}))

    found = mined(labelled.select(open_kinds("tokens").alias("tokens"), "verdict"), support, confidence)
    rules = needed(saved(found))
    return kind, pruned([*never, *((tuple(r["items"]), r["verdict"], r["confidence"], r["support"]) for r in rules.toLocalIterator())])


def pruned(rules: list[tuple[tuple[str, ...], str, float, float]]) -> list[tuple[tuple[str, ...], str, float, float]]:
    """Rules without those that a smaller one makes needless, in the order in which they decide."""
    by_item: dict[str, list[tuple[frozenset, str, float]]] = defaultdict(list)
    out = []
    for items, verdict, confidence, support in sorted(rules, key=lambda r: (len(r[0]), r[0], r[1])):
        own = frozenset(items)
        if not any(s <= own and v == verdict and c >= confidence for i in items for s, v, c in by_item[i]):
            by_item[items[0]].append((own, verdict, confidence))
            out.append((items, verdict, confidence, support))
    return sorted(out, key=lambda r: (-r[2], -r[3], -len(r[0]), r[1] != BLOCK, r[0]))


def index_of(rules: list[tuple[tuple[str, ...], str, float, float]]) -> dict[str, list[tuple[int, frozenset]]]:
    """Inverted index: for each rule's rarest token over all rules, the rule's place and tokens."""
    uses: dict[str, int] = defaultdict(int)
    for items, *_ in rules:
        for t in items:
            uses[t] += 1
    index: dict[str, list[tuple[int, frozenset]]] = defaultdict(list)
    for place, (items, *_) in enumerate(rules):
        index[min(items, key=lambda t: (uses[t], t))].append((place, frozenset(items)))
    return dict(index)


def first_rule(items, index: dict[str, list[tuple[int, frozenset]]]) -> int | None:
    """Place of the first rule whose tokens are all in ``items``, or None."""
    own = frozenset(items)
    places = [next((p for p, need in index.get(t, ()) if need <= own), None) for t in own]
    return min((p for p in places if p is not None), default=None)


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, learned`` for the URL of every row.

    ``rule`` is the given rule that decides, or null; then ``learned`` has the tokens of
    the mined rule that does, and where there is none the verdict is to allow. A null
    URL, or one without ``://``, has an empty host and path, no tokens and is allowed.
    Rows that repeat a URL are labelled each and judged alike; other columns stay, those
    named like the new ones are replaced. No rows give no rows.
    """
    named = ["host", "path", "rule", "verdict", "learned"]
    rows = parsed(pages.drop(*[n for n in named if n in pages.columns and n != url]), url)
    rows = rows.withColumn("_fit", _fitting(rules))
    labelled = rows.where("_fit is not null").select(tokens(F.col("host"), F.col("path")).alias("tokens"), "_fit.verdict", F.xxhash64(url).alias("deal"))
    kind, order = learned_rules(labelled)
    sent = pages.sparkSession.sparkContext.broadcast((kind, index_of(order), [(i, v) for i, v, *_ in order]))

    @F.pandas_udf("tokens array<string>, verdict string")
    def by_index(column: pd.Series) -> pd.DataFrame:
        kind, index, known = sent.value

        def decided(items):
            own: dict[str, str] = {}
            for t in sorted(items) if items is not None else ():
                if t in kind:
                    own.setdefault(kind[t], t)
            place = first_rule(own, index)
            return (None, ALLOW) if place is None else (sorted(own[k] for k in known[place][0]), known[place][1])

        return pd.DataFrame([decided(items) for items in column], columns=["tokens", "verdict"])

    undecided = F.when(F.col("_fit").isNull(), tokens(F.col("host"), F.col("path")))
    rows = rows.withColumn("_learned", by_index(undecided))
    return rows.withColumns(
        {
            "rule": F.col("_fit.rule"),
            "verdict": F.coalesce("_fit.verdict", "_learned.verdict"),
            "learned": F.when(F.col("_fit").isNull(), F.col("_learned.tokens")),
        }
    ).drop("_fit", "_learned")
