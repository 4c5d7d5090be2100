"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The access-log layout whose fields are extracted.
ACCESS_LOG = r'^([\d.]+) (\S+) (\S+) \[([\w\d:/]+\s[+\-]\d{4})\] "(.+?)" (\d{3}) ([\d\-]+) "([^"]+)" "([^"]+)".*'
LOG_FIELDS = ("ip", "ident", "user", "time", "query", "status", "bytes", "referrer", "agent")

# What counts as a dataset type, an action and a cover call.
DATASET_TYPE = r"(Java)(Double|Hadoop|NewHadoop|Pair)?(RDD)(<.*>)?"
ACTIONS = (
    "aggregate", "treeAggregate",
    "collect", "collectAsync", "collectPartitions",
    "count", "countApprox", "countApproxDistinct", "countAsync",
    "countByKey", "countByValue", "countByValueApprox",
    "first", "fold",
    "foreach", "foreachAsync", "foreachPartition", "foreachPartitionAsync",
    "max", "min", "reduce", "treeReduce",
    "saveAsObjectFile", "saveAsTextFile", "saveAsSequenceFile",
    "take", "takeAsync", "takeOrdered", "takeSample", "top",
)
COVER_CALL = r".*((cache\(.*\))|(persist\(.*\))).*"


def split_space(text: Column) -> Column:
    """Tokens between single spaces.

    Leading and inner empty tokens stay, trailing ones go; an empty line has one
    empty token and a line of spaces none.
    """
    trimmed = F.rtrim(text)
    only_spaces = (trimmed == "") & (text != "")
    return F.when(only_spaces, F.array().cast("array<string>")).otherwise(F.split(trimmed, " "))


def split_whitespace(text: Column) -> Column:
    """Tokens between runs of whitespace."""
    return F.split(text, r"\s+")


def log_field(line: Column, name: str) -> Column:
    """One named field of an access-log line; empty when the line does not match."""
    return F.regexp_extract(line, ACCESS_LOG, LOG_FIELDS.index(name) + 1)


def is_log_line(line: Column) -> Column:
    return line.rlike(ACCESS_LOG)


def log_parts(line: Column, *names: str) -> Column:
    """The named fields in one pass of the pattern, separated by line ends.

    No field can hold a line end. A line that does not match comes back as it is;
    one that matches never equals its own parts.
    """
    wanted = "\n".join(f"${LOG_FIELDS.index(name) + 1}" for name in names)
    return F.regexp_replace(line, ACCESS_LOG + "(?s:.*)", wanted)


def whole_token(words: tuple[str, ...]) -> str:
    """Pattern matching a token that is exactly one of ``words``."""
    return "^(" + "|".join(words) + ")$"


def matching_tokens(text: Column, pattern: str, separator: str = r"\s+") -> Column:
    """All tokens of ``text`` that match ``pattern``, in order, repeats kept."""
    return F.filter(F.split(text, separator), lambda token: token.rlike(pattern))


def chain_root(chain: Column) -> Column:
    """Leftmost name of a dotted call chain."""
    return F.substring_index(chain, ".", 1)
