"""Repeatable sampling rules that any engine with md5 can restate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, key: Column) -> Column:
    """Pseudo-random order key of a row: md5 of ``seed:key``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def bucket(seed: int, key: Column, buckets: int) -> Column:
    """Bucket in ``0 .. buckets-1``, spread evenly whatever the keys look like."""
    head = F.conv(F.substring(digest(seed, key), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(buckets))
