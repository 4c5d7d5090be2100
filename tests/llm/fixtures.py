"""Rows that every operator on texts must take: nulls, empty and very long texts, repeats, clashing column names."""

import re

ODD = [
    (1, None, "en", "s0"), (2, "", "en", None), (3, " \n\t ", None, "s1"), (4, "one", "en", "s1"), (5, "One", "fr", "s1"),
    (6, "a b c d", "en", "s2"), (7, "A b\tC  d", "en", "s2"), (8, "word " * 30000, "en", "s2"), (9, "x" * 60000, None, None),
    (10, "Café 日本語 \U0001f600 naïve déjà vu encore", "fr", "s1"), (10, "twice the same id with another text here", "en", "s0"),
    (11, "same same same same same same", "en", "s0"), (11, "same same same same same same", "en", "s0"),
    (None, "a row without an id but with six words", "en", "s0"), (None, None, None, None),
]
CLASHES = ["cell", "node", "key", "n", "block", "component", "kept", "size", "piece", "lang_pred"]


def odd_documents(spark, extra=()):
    """The odd rows and ``extra`` ones, with columns whose names the operators use inside."""
    rows = [(*r, len(r[1] or ""), *([r[0]] * len(CLASHES))) for r in [*ODD, *extra]]
    clash = ", ".join(f"{c} long" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clash}")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
