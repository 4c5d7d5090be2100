"""Dataset types, calls and call-chain roots in lines of program text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from millrace.functions.text import ACTIONS, COVER_CALL

# The dataset types' names, the calls that cover a dataset, and words that a call may follow.
TYPE_NAME = "Java(Double|Hadoop|NewHadoop|Pair)?RDD"
COVERS = ("cache", "persist")
BEFORE_A_CALL = ("return", "else", "do", "throw", "case", "assert", "yield")

FOUND = ArrayType(StructType([StructField(name, StringType()) for name in ("what", "token", "root")]))

_TOKEN = re.compile(
    r"""//.*|/\*.*?(?:\*/|$)|"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|\S""", re.DOTALL
)
_OPENS = {")": "(", "]": "[", ">": "<", "}": "{"}


def _is_name(token: str) -> bool:
    return token[0].isalpha() or token[0] in "_$"


def tokens(text: str) -> list[str]:
    """Names, numbers, literals and single marks; comments go."""
    return [t for t in _TOKEN.findall(text) if not t.startswith(("//", "/*"))]


def _close(items: list[str], at: int) -> int | None:
    """Where the ``<`` at ``at`` is closed, or None: only names, marks of type arguments and pairs lie between."""
    depth = 0
    for k in range(at, len(items)):
        if items[k] == "<":
            depth += 1
        elif items[k] == ">":
            depth -= 1
            if not depth:
                return k
        elif not (_is_name(items[k]) or items[k] in ",.?&[]@"):
            return None
    return None


def _open(items: list[str], at: int) -> int | None:
    """Where the closing mark at ``at`` was opened, or None."""
    closing, opening, depth = items[at], _OPENS[items[at]], 0
    for k in range(at, -1, -1):
        depth += (items[k] == closing) - (items[k] == opening)
        if not depth:
            return k
    return None


def _is_call(items: list[str], at: int) -> bool:
    """Whether the name at ``at``, with ``(`` behind it, is invoked there and not declared or constructed."""
    before = items[at - 1] if at else ""
    if before == ">":  # type arguments of the call come after a dot, those of a declared result don't
        opened = _open(items, at - 1)
        return opened is None or (opened > 0 and items[opened - 1] == ".")
    return not before or not _is_name(before) or before in BEFORE_A_CALL


def _root(items: list[str], at: int) -> str | None:
    """Leftmost name of the chain that ends in the name at ``at``."""
    while True:
        before = at - 1
        if before >= 0 and items[before] == ">":
            opened = _open(items, before)
            before = opened - 1 if opened is not None else before
        if before < 1 or items[before] != ".":
            return items[at]
        at = before - 1
        while items[at] in (")", "]"):
            opened = _open(items, at)
            if opened is None:
                return None
            if not opened or not (_is_name(items[opened - 1]) or items[opened - 1] in (")", "]", ">")):
                return next((t for t in items[opened:at] if _is_name(t)), None)  # a bracketed expression: its first name
            at = opened - 1
            if items[at] == ">":
                opened = _open(items, at)
                at = opened - 1 if opened else at
                break
        if items[at] == "this" or not _is_name(items[at]):
            following = items[at + 2] if at + 2 < len(items) else None
            return following if items[at] == "this" else None


def scan(text: str | None) -> list[tuple[str, str, str | None]]:
    """``(what, token, root)`` of each dataset type, action call and cover call of a line, in order.

    A type comes with its arguments, however deep, without blanks. A call's root is the
    leftmost name of its chain. Names that are not invoked, literals, comments,
    declarations and constructors are no calls. A null line has nothing.
    """
    items, out = tokens(text or ""), []
    for k, token in enumerate(items):
        following = items[k + 1] if k + 1 < len(items) else ""
        if re.fullmatch(TYPE_NAME, token):
            end = _close(items, k + 1) if following == "<" else None
            out.append(("type", "".join(items[k : end + 1]) if end else token, None))
        elif following == "(" and token in ACTIONS and _is_call(items, k):
            out.append(("action", token, _root(items, k)))
        elif following == "(" and token in COVERS and _is_call(items, k):
            out.append(("cover", token, _root(items, k)))
    return out


_scan = F.udf(scan, FOUND, useArrow=True)


def program_marks(text: Column) -> Column:
    """What ``scan`` finds in each line; lines that hold none of its words are not scanned."""
    words = "|".join(sorted({*ACTIONS, *COVERS}))
    return F.when(text.rlike(rf"{TYPE_NAME}|\b({words})\s*\(") | text.rlike(COVER_CALL), _scan(text))
