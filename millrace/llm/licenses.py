"""License notices in texts: winnowed fingerprints find where, banded alignment tells how much.

Every run of ``GRAM + WINNOW - 1`` words that a text shares with a template holds a
fingerprint of both, so an inverted index over the templates' fingerprints misses none.
Hits on about one diagonal are one candidate, which is aligned word by word within a
band around that diagonal. No rows are shuffled or grouped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.buffers import lower, pieces, shingles, text_bytes, word_hashes, words
from millrace.llm.license_texts import NOTICES

GRAM = 3
WINNOW = 2
BAND = 8
#: Reported from this share of a template's words on.
COVERAGE = 0.6
#: The index goes to every task, so the templates' words are bounded.
MOST_WORDS = 2_000_000

# Notices by which texts state a public license, then those of ``license_texts`` that are not among them.
_FIRST = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files, to deal in the Software without restriction"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TEMPLATES = (*_FIRST, *(notice for notice in NOTICES if notice not in _FIRST))

_APART = np.ones(256, bool)  # all but letters, digits and bytes of longer characters part words
_APART[48:58] = _APART[97:123] = _APART[128:] = False


def _winnowed(grams: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: in every ``WINNOW`` n-grams of a text in a row, the last of the smallest."""
    count = np.diff(upto)
    text = np.repeat(np.arange(len(count)), count)
    short = np.flatnonzero((count[text] < WINNOW)) if len(grams) else np.zeros(0, np.int64)
    if len(grams) < WINNOW:
        return short
    window = sliding_window_view(grams, WINNOW)
    whole = text[: len(window)] == text[WINNOW - 1 :]
    at = np.flatnonzero(whole)
    chosen = at + (WINNOW - 1) - window[at][:, ::-1].argmin(axis=1)
    return np.unique(np.concatenate([short, chosen]))


def _hashed(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple]:
    data, starts = text_bytes(texts)
    for first, last in pieces(starts, limit):
        raw = data[starts[first] : starts[last]]
        part, own = lower(raw), starts[first : last + 1] - starts[first]
        begin, end, upto = words(part, own, _APART)
        yield first, raw, own, begin, end, upto, word_hashes(part, begin, end)


class TemplateIndex:
    """Fingerprint to (template, place), and the templates' words."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        self.names = [name for name, _ in templates]
        self.words: list[list[int]] = []
        self.counts: list[Counter] = []
        found = []
        for number, (_, text) in enumerate(templates):
            _, _, _, _, _, upto, word = next(_hashed(pa.array([text], pa.large_string())))
            self.words.append(word.tolist())
            self.counts.append(Counter(self.words[-1]))
            grams, ends = shingles(word, upto, GRAM)
            at = _winnowed(grams, ends)
            found += [(int(grams[a]), number, int(a)) for a in at]
        if sum(map(len, self.words)) > MOST_WORDS:
            raise ValueError(f"templates have more than {MOST_WORDS} words; scan with parts of them")
        found.sort()
        self.keys = np.array([f[0] for f in found], np.uint64)
        self.template, self.place = (np.array([f[k] for f in found], np.int64) for k in (1, 2))

    def hits(self, grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the fingerprints at ``at``: their places once for every entry of the index, the template, the place in it."""
        low = np.searchsorted(self.keys, grams[at], side="left")
        many = np.searchsorted(self.keys, grams[at], side="right") - low
        entry = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(at, many), self.template[entry], self.place[entry]


def align(template: list[int], text: list[int | None], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Matched words, begin and end in ``text`` of the best local alignment within ``band`` of the diagonal ``shift``.

    A match is worth 1; a word changed, left out or put in costs 1. No alignment
    passes a None in ``text``. Each cell of the band
    keeps its score, matches and begin, so only two rows are held.
    """
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    for i, wanted in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(text), i + shift + band + 1)):
            if text[j] is None:
                continue
            same = text[j] == wanted
            score, matched, begin = above.get(j - 1, (0, 0, j))
            options = [(score + 1, matched + 1, begin) if same else (score - 1, matched, begin)]
            if j in above:
                score, matched, begin = above[j]
                options.append((score - 1, matched, begin))
            if j - 1 in row:
                score, matched, begin = row[j - 1]
                options.append((score - 1, matched, begin))
            top = max(options)
            if top[0] > 0:
                row[j] = top
                if (top[0], top[1]) > best[:2]:
                    best = (top[0], top[1], top[2], j + 1)
        above = row
    return best[1], best[2], best[3]


def _at_most(counts: Counter, text: list[int | None]) -> int:
    """No alignment matches more words than the texts have in common, in any order."""
    return sum(min(n, counts[w]) for w, n in Counter(w for w in text if w in counts).items())


def _spans(index: TemplateIndex, text: list[int | None], candidates: list[list[int]]) -> Iterator[tuple[int, int, int, int]]:
    """Template, matched words, begin and end of the spans of a text, the best covered first; ``text`` is used up.

    A candidate waits with the most that it could cover. The best one is aligned when
    its turn comes, around the spans taken before; it stands if it is still the best,
    and is tried again for a copy beside it.
    """
    waiting: list[tuple[float, int, int, int, int, int]] = []

    def part(number: int, shift: int) -> tuple[int, list[int | None]]:
        low = max(0, shift - BAND)
        return low, text[low : max(0, shift + len(index.words[number]) + 2 * BAND)]

    def wait(number: int, shift: int) -> None:
        size, (_, here) = len(index.words[number]), part(number, shift)
        most = _at_most(index.counts[number], here) if len(here) >= COVERAGE * size else 0
        if most and most >= COVERAGE * size:
            heappush(waiting, (-most / size, -most, -1, -1, number, shift))

    for number, shift in candidates:
        wait(number, shift)
    while waiting:
        _, less, a, b, number, shift = heappop(waiting)
        if a < 0:
            low, here = part(number, shift)
            wanted = index.words[number]
            if _at_most(index.counts[number], here) < -less:  # words of it were taken since
                wait(number, shift)
                continue
            matched, a, b = align(wanted, here, shift - low)
            if matched and matched >= COVERAGE * len(wanted):
                heappush(waiting, (-matched / len(wanted), -matched, low + a, low + b, number, shift))
        else:
            if None not in text[a:b]:
                yield number, -less, a, b
                text[a:b] = [None] * (b - a)
            wait(number, shift)


def _scan(index: TemplateIndex, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int, int]]:
    """Text number, template, coverage, matched words, begin and end in code points."""
    for first, raw, starts, begin, end, upto, word in _hashed(texts):
        grams, ends = shingles(word, upto, GRAM)
        at, template, place = index.hits(grams, _winnowed(grams, ends))
        if not len(at):
            continue
        text = np.searchsorted(ends, at, side="right") - 1
        diagonal = at - ends[text] - place
        key = np.unique(np.stack([text, template, diagonal], axis=1), axis=0)
        found: dict[int, list[list[int]]] = {}
        open_ = (-1, -1, 0)
        for t, number, shift in key.tolist():
            if (t, number) == open_[:2] and shift - open_[2] <= BAND // 2:
                continue
            open_ = (t, number, shift)
            found.setdefault(t, []).append([number, shift])
        for t, candidates in found.items():
            span = raw[starts[t] : starts[t + 1]]
            for number, matched, a, b in _spans(index, word[upto[t] : upto[t + 1]].tolist(), candidates):
                left, right = begin[upto[t] + a] - starts[t], end[upto[t] + b - 1] - starts[t]
                points = [int(np.count_nonzero((span[:n] & 0xC0) != 0x80)) for n in (left, right)]
                yield first + t, number, matched / len(index.words[number]), matched, *points


def license_spans(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``doc_id, license, coverage, matched, start, end``: every notice found in ``docs(doc_id, text)``.

    ``coverage`` is the share of the template's words that align, ``start`` and ``end``
    are code points. A notice that occurs several times gives several rows; where
    templates overlap in a text, the one with the largest coverage stands. Null, empty and unmatched texts give no rows, nor does an
    empty table; rows that repeat give rows each; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(TemplateIndex(templates))

    def scan(batches):
        for batch in batches:
            rows = list(_scan(sent.value, batch["text"]))
            number, template, coverage, matched, start, end = zip(*rows, strict=True) if rows else ([],) * 6
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"].take(pa.array(number, pa.int64())),
                    "license": pa.array([sent.value.names[t] for t in template], pa.string()),
                    "coverage": pa.array(coverage, pa.float64()), "matched": pa.array(matched, pa.int64()),
                    "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64()),
                }
            )

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return typed.mapInArrow(scan, "doc_id long, license string, coverage double, matched long, start long, end long")
