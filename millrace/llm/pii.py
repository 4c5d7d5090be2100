"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds select.

Everything on rows is a column expression. Base patterns always count. Looser patterns
propose more, overlapping what else there is; trees learn from all documents how base
spans look in format and context. They see a span as a base pattern would have it, so
not what sets the two apart, and a proposal is added where, at its score, most spans
are base ones. The trees are fitted on counts per
combination of binned features, at most ``BINS`` of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.boosting import BoostedTrees, thresholds

KINDS = ("email", "ip", "card", "phone")

# What counts as personal data. Runs are taken whole and not given back (possessive), and an email starts
# where its run of characters does, or right after the match before: the same matches, in linear time and constant stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+"
    r"(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\])\x20?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\(?[0-9]{1,4}\)?)(?:[\x20./()-]{1,2}[0-9]{2,5}){2,5}(?![0-9])",
}
CONTEXT = (
    r"(?i)mail|kontakt|contact|correo|courriel|address|adresse|phone|fon|call|tel|mobil|card|kart|carte|tarjeta|visa|"
    r"host|server|login"
)
CONTEXT_CHARS = 40
#: At the scores from which a proposal is added, this share of all spans are base spans. Proposals that are personal data
#: count against it, so the share of personal data is higher.
PRECISION = 0.8
FEATURES = ("kind", "digits", "length", "left", "right", "context", "check", "other")
BINS = 4 * 8 * 8 * 4 * 4 * 2 * 2 * 2
#: Rows of an array that one prefix scan takes at a time.
BLOCK = 256
#: Neighbours on either side among which a span of another kind is looked for.
NEAR = 4

#: A text without one of these has no match of the kind.
NEEDS = {"email": r"@|\(at\)|\[at\]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}


def _held(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns, each computed once for its row however often it is used later on.

    The optimizer moves an expression into all its uses, lambdas included; it doesn't
    move it through a generator.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _prefixes(rows: DataFrame, scans: dict[str, tuple[Column, Callable, Callable, int]]) -> DataFrame:
    """``rows`` with a column for each of ``scans``: what the values before each place add up to, in blocks.

    A scan is ``(n, value, op, zero)``, with ``value(i)`` an int. A block's values are run
    through one after the other, then the blocks' totals, so an array of n takes n x BLOCK
    / 2 copies and (n / BLOCK) squared / 2: proportional to n up to some millions.
    """

    def local(n: Column, value: Callable, op: Callable, zero: int) -> Column:
        last = lambda done: F.element_at(done, -1)
        block = lambda b: F.aggregate(
            F.sequence(b * BLOCK, F.least(n, (b + 1) * BLOCK) - 1), F.array(F.lit(zero)),
            lambda done, i: F.concat(done, F.array(op(last(done), value(i)))),
        )
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block)
        return F.when(n > 0, blocks).otherwise(F.array().cast("array<array<int>>"))

    def totals(name: str, op: Callable, zero: int) -> Column:
        return F.aggregate(
            f"{name}_local", F.array(F.lit(zero)),
            lambda done, one: F.concat(done, F.array(op(F.element_at(done, -1), F.element_at(one, -1)))),
        )

    def whole(name: str, op: Callable) -> Column:
        return F.flatten(F.transform(
            f"{name}_local",
            lambda one, b: F.transform(F.slice(one, 1, F.size(one) - 1), lambda x: op(F.get(f"{name}_totals", b), x)),
        ))

    rows = _held(rows, **{f"{n}_local": local(*scan) for n, scan in scans.items()})
    rows = _held(rows, **{f"{n}_totals": totals(n, op, zero) for n, (_, _, op, zero) in scans.items()})
    return _held(rows, **{n: whole(n, op) for n, (_, _, op, _) in scans.items()})


def _spans(name: str) -> Column:
    """``[(start, end, match, before, after)]`` of the matches in ``{name}_found``, in code points: gaps and matches alternate.

    ``before`` goes back to the match before at most, ``after`` is one character.
    """
    gap = lambda i: F.get(f"{name}_gaps", i)
    found = lambda i: F.coalesce(F.get(f"{name}_found", i), F.lit(""))

    def span(match: Column, i: Column) -> Column:
        start = F.get(f"{name}_at", i) + F.length(gap(i))
        earlier = F.when(i > 0, found(i - 1)).otherwise("")
        return F.struct(
            start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"),
            F.right(F.concat(earlier, gap(i)), F.lit(CONTEXT_CHARS)).alias("before"),
            F.substring(F.concat(gap(i + 1), found(i + 1)), 1, 1).alias("after"),
        )

    return F.transform(f"{name}_found", span)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a text of digits is a multiple of ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.when(d == "", None).otherwise(d.cast("int")))
    doubled = F.transform(
        values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    )
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _octets(match: Column) -> Column:
    """Whether every run of digits, leading zeros apart, is at most 255."""
    return F.forall(
        F.regexp_extract_all(match, F.lit("0*([0-9]+)"), F.lit(1)), lambda d: (F.length(d) <= 3) & (d.cast("int") <= 255)
    )


def _passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(match)
    number = F.length(_digits(match))
    if kind == "card":
        return number.between(14, 19) & luhn(_digits(match))
    return number.between(10, 15)


def _of_kind(number: int):
    return lambda span: span["kind"] == number


def _side(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^[\p{L}\p{N}]$"), 2).otherwise(3)


def _plain(kind: str, match: Column) -> Column:
    """The span as a base pattern would have it, so that spans written in other ways look alike."""
    if kind == "email":
        signs = F.regexp_replace(F.regexp_replace(match, r"\(at\)|\[at\]", "@"), r"\(dot\)|\[dot\]", ".")
        return F.replace(signs, F.lit(" "), F.lit(""))
    if kind == "ip":
        return F.regexp_replace(match, r"[\x20\[\]]", "")
    return _digits(match)


def _features(kind: str, plain: Column, span: Column) -> list[Column]:
    """Binned numbers of one span, those of FEATURES but the last; what tells a base match from a loose one is left out."""
    digits = F.length(_digits(plain))
    if kind == "email":
        check = plain.rlike(r"[A-Za-z]{2,}$")
    elif kind == "ip":
        check = _octets(plain)
    elif kind == "card":
        check = luhn(plain)
    else:
        check = digits.between(10, 15)
    return [
        F.lit(KINDS.index(kind)), F.least(F.floor(digits / 3), F.lit(7)), F.least(F.floor(F.length(plain) / 4), F.lit(7)),
        _side(F.right(span["before"], F.lit(1))), _side(span["after"]), span["before"].rlike(CONTEXT), check,
    ]


def _apart(a: Column, b: Column) -> Column:
    return (a["end"] <= b["start"]) | (b["end"] <= a["start"])


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii(text, spans)``; spans are ``(start, loose, end, f0..f7)`` in order, f0 the kind's number.

    Base spans have ``loose`` 0, and what the loose patterns propose 1. A proposal may
    overlap base spans and others; one inside a base span of its kind adds nothing and is left out.
    """
    patterns = {f"pii_b{n}": (k, BASE[k]) for n, k in enumerate(KINDS)} | {f"pii_l{n}": (k, LOOSE[k]) for n, k in enumerate(KINDS)}
    text, nothing = F.col("pii_text"), F.array().cast("array<string>")
    rows = docs.withColumn("pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = _held(rows, **{f"pii_has_{k}": text.rlike(p) for k, p in (("email", NEEDS["email"]), ("digit", NEEDS["ip"]))})
    has = {k: F.col("pii_has_email" if k == "email" else "pii_has_digit") for k in KINDS}
    rows = _held(rows, **{
        f"{n}_found": F.when(has[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(nothing)
        for n, (k, p) in patterns.items()
    })
    rows = _held(rows, **{
        f"{n}_gaps": F.when(F.size(f"{n}_found") > 0, F.split(text, p, -1)).otherwise(nothing) for n, (_, p) in patterns.items()
    })

    def step(name: str) -> Callable:
        return lambda i: F.length(F.get(f"{name}_gaps", i)) + F.length(F.get(f"{name}_found", i))

    rows = _prefixes(rows, {f"{n}_at": (F.size(f"{n}_found"), step(n), lambda a, b: a + b, 0) for n in patterns})

    def described(kind: str, name: str, loose: int) -> Column:
        spans = _spans(name) if loose else F.filter(_spans(name), lambda s: _passes(kind, s["match"]))

        def one(s: Column) -> Column:
            named = [v.cast("int").alias(f"f{n}") for n, v in enumerate(_features(kind, _plain(kind, s["match"]), s))]
            return F.struct(s["start"].alias("start"), F.lit(loose).alias("loose"), s["end"].alias("end"), *named)

        return F.transform(spans, one)

    rows = _held(rows, **{
        f"pii_k{n}": F.array_sort(F.concat(described(k, f"pii_b{n}", 0), described(k, f"pii_l{n}", 1))) for n, k in enumerate(KINDS)
    })

    def base_end(name: str) -> Callable:
        return lambda i: F.when(F.get(name, i)["loose"] == 0, F.get(name, i)["end"]).otherwise(0)

    kinds = [f"pii_k{n}" for n in range(len(KINDS))]
    rows = _prefixes(rows, {f"{k}_upto": (F.size(k), base_end(k), F.greatest, 0) for k in kinds})

    def new(name: str) -> Column:
        return F.filter(name, lambda s, i: (s["loose"] == 0) | (F.get(f"{name}_upto", i) < s["end"]))

    rows = _held(rows, pii_all=F.array_sort(F.concat(*map(new, kinds))))

    def touched(s: Column, i: Column) -> Column:
        near = F.slice("pii_all", F.greatest(i - NEAR, F.lit(0)) + 1, F.lit(2 * NEAR + 1))
        return F.exists(near, lambda b: (b["loose"] == 0) & (b["f0"] != s["f0"]) & ~_apart(b, s))

    last = len(FEATURES) - 1
    spans = F.transform("pii_all", lambda s, i: s.withField(f"f{last}", touched(s, i).cast("int")))
    return _held(rows, pii=F.struct(text.alias("text"), spans.alias("spans"))).select(*docs.columns, "pii")


class Detector:
    """Trees and thresholds, fitted on the candidates of all documents."""

    def __init__(self, trees: BoostedTrees | None, limits: dict[int, float]):
        self.trees, self.limits = trees, limits

    @staticmethod
    def fit(docs: DataFrame, precision: float = PRECISION) -> Detector:
        """Counts base and loose spans per combination of features, four fifths to fit and one to calibrate.

        The counts of all documents come to the driver, at most 2 * BINS rows.
        """
        rows = candidates(docs.select("doc_id", "text"))
        held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0
        names = [f"f{n}" for n in range(len(FEATURES))]
        spread = rows.select(held.alias("held"), F.explode("pii.spans").alias("s")).select("held", "s.*")
        counts = spread.groupBy("held", *names).agg(
            F.sum(1 - F.col("loose")).alias("positive"), F.sum("loose").alias("negative")
        ).orderBy("held", *names).collect()
        if not counts:
            return Detector(None, {})
        x = np.array([[r[n] for n in names] for r in counts], np.int64)
        positive, negative = (np.array([r[n] for r in counts], np.int64) for n in ("positive", "negative"))
        test = np.array([r.held for r in counts], bool)
        trees = BoostedTrees().fit(x[~test], positive[~test], negative[~test])
        limits = thresholds(x[test, 0], trees.probability(x[test]), positive[test], negative[test], precision)
        return Detector(trees, limits)

    def detect(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``pii(text, base, added)``: sorted ``(start, kind number, end)``."""
        rows = candidates(docs)
        short = lambda s: F.struct(s["start"].alias("start"), s["f0"].alias("kind"), s["end"].alias("end"))
        if self.trees is None:
            chosen = lambda s: F.lit(False)
        else:
            limit = F.array(*[F.lit(self.limits[k]) for k in range(len(KINDS))])
            score = lambda s: self.trees.column([s[f"f{n}"] for n in range(len(FEATURES))])
            chosen = lambda s: (s["loose"] == 1) & (score(s) >= F.element_at(limit, s["f0"] + 1))
        sorted_spans = lambda keep: F.array_sort(F.transform(F.filter("pii.spans", keep), short))
        found = F.struct(
            F.col("pii.text").alias("text"), sorted_spans(lambda s: s["loose"] == 0).alias("base"),
            sorted_spans(chosen).alias("added"),
        )
        return _held(rows, pii_found=found).drop("pii")


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for every row of ``docs(doc_id, text)``.

    The four counts and the digest are of base spans; ``spans`` has the added ones too.
    A null or empty text has none: counts 0, the digest of nothing, an empty text. Rows
    that repeat are each returned, a null doc_id stays null, no rows give no rows, and
    other columns are not read. Positions are code points, end exclusive.
    """
    rows = Detector.fit(docs).detect(docs.select("doc_id", "text"))
    counts = [
        F.size(F.filter("pii_found.base", _of_kind(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)
    ]
    return rows.select(
        "doc_id", *counts, F.sha2(_joined(F.col("pii_found.base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("pii_found.base", "pii_found.added"))).alias("spans"),
        F.size("pii_found.added").cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by the kind of its first in brackets.

    A null or empty text stays as it is, as does one without spans; rows that repeat and
    null doc_ids are kept, all other columns too, and no rows give no rows.
    """
    rows = Detector.fit(docs).detect(docs)
    text, found = F.col("pii_found.text"), F.array_sort(F.concat("pii_found.base", "pii_found.added"))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(done: Column, s: Column) -> Column:
        cut = F.array(
            F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.element_at(marks, s["kind"] + 1)
        )
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(s["start"] >= done["at"], F.concat(done["parts"], cut)).otherwise(done["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate(
        found, start, step,
        lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text))),
    )
    return rows.withColumn("text", F.when(F.size(found) > 0, clean).otherwise(F.col("text"))).select(*docs.columns)
