"""Exact top-k inner products of integer vectors by MaxScore over per-shard postings.

A dimension is two terms, its positive and its negative values, each with a posting list
of vectors in order of impact. For a query only one of the two can add to a score; the
other takes away, so bounds of the adding terms bound the score. Terms whose bounds
together stay under the k-th best score so far are non-essential: a vector in none of
the essential lists can't be among the best. Essential lists are traversed, and what
they turn up is completed term by term while it is still competitive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from millrace.llm.vectors import finite, search

SCALE = 1024
#: Head of each of the strongest lists that is scored in full to find a first threshold.
HEAD = 8


class Postings:
    def __init__(self, x: np.ndarray, k: int):
        whole = np.floor(SCALE * x)
        # Products of numbers this small sum up within 64 bits; larger ones are counted in whole Python numbers.
        small = not whole.size or np.abs(whole).max() < 2.0**27
        self.x = whole.astype(np.int64) if small else _whole(whole)
        self.k, self.dims = k, x.shape[1]
        self.lists = {}
        for d in range(self.dims):
            column = self.x[:, d]
            for sign in (1, -1):
                holders = np.flatnonzero(sign * column > 0)
                self.lists[d, sign] = holders[np.argsort(-sign * column[holders], kind="stable")]

    def search(self, queries: np.ndarray, more: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
        whole = np.floor(SCALE * queries)
        small = np.abs(whole).max(initial=0) < 2.0**27 and self.x.dtype == np.int64
        return [self._one(q, self.k + more) for q in (whole.astype(np.int64) if small else _whole(whole))]

    def _one(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.x.astype(object) if q.dtype == object and self.x.dtype != object else self.x
        dims = [d for d in range(self.dims) if q[d]]
        plus = {d: self.lists[d, 1 if q[d] > 0 else -1] for d in dims}
        bound = {d: q[d] * x[plus[d][0], d] if len(plus[d]) else 0 for d in dims}
        dims.sort(key=lambda d: bound[d])  # least first
        k = min(k, len(x))
        heads = np.unique(np.concatenate([plus[d][:HEAD] for d in dims[-16:]] + [np.arange(k)]))
        known = x[heads] @ q
        threshold = np.sort(known)[-k]  # k vectors score as much
        upto = np.cumsum(np.array([bound[d] for d in dims], dtype=q.dtype)) if dims else np.zeros(0, q.dtype)
        split = int(np.searchsorted(upto, threshold)) if threshold > 0 else 0  # terms before it together stay under
        essential, other = dims[split:], dims[:split]
        if threshold <= 0:
            found = np.arange(len(x))  # vectors without any adding term may be among the best
        else:
            mark = np.zeros(len(x), bool)
            for d in essential:
                mark[plus[d]] = True
            found = np.flatnonzero(mark)
        score = np.zeros(len(found), q.dtype)
        rest = sum((bound[d] for d in dims), 0)
        for d in [*essential[::-1], *other[::-1]]:  # the strongest term first
            score = score + x[found, d] * q[d]
            rest -= bound[d]
            alive = score + rest >= threshold
            if not alive.all():
                found, score = found[alive], score[alive]
        if len(found) > k:
            threshold = max(threshold, np.sort(score)[-k])
        top = score >= threshold
        return found[top], score[top]


def _whole(values: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in values], dtype=object).reshape(values.shape)


def best(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of ``floor(1024 * x)`` for each query row.

    All rows but the query's own are candidates, zero vectors included. Vectors that are
    null, empty or hold null, NaN or infinite components take no part, nor do rows
    without an id; vectors of different lengths are not compared. Equal scores go by
    vec_id; rows that repeat an id are the query's own row too, and each pair of rows has
    its own rank, as in the query's SQL. Scores beyond 64 bits
    count as the largest or least 64-bit number. Fewer candidates give fewer rows, none
    give none. Other columns are not read.
    """
    return search(finite(vectors), is_query, k, _Saturated, "long")


class _Saturated(Postings):
    def search(self, queries: np.ndarray, more: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
        found = super().search(queries, more)
        if not any(s.dtype == object for _, s in found):
            return found
        low, high = -(1 << 63), (1 << 63) - 1
        return [(n, np.array([min(max(int(v), low), high) for v in s], np.int64)) for n, s in found]
