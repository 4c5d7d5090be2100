"""Texts of one Arrow batch as flat NumPy arrays: words, word hashes, shingles.

A word is a run of bytes other than space and 0x09-0x0D, after A-Z are lower-cased.
Nothing here loops over words, so the cost is a few passes over the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose output bits all depend on all input bits (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after the other, and where each begins (with the end as last entry); null is empty."""
    filled = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
    if filled.null_count:
        filled = filled.fill_null("")
    starts = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def pieces(starts: np.ndarray, limit: int):
    """Runs of texts of about ``limit`` bytes, so that work arrays stay small; a longer text is a run alone."""
    first = 0
    while first < len(starts) - 1:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + limit, side="right")) - 1)
        yield first, last
        first = last


def words(data: np.ndarray, starts: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the number of words up to each text (with the total as last entry)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~blank[data]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    # A text boundary ends a word as a blank does.
    edge = starts[(starts > 0) & (starts < len(data))]
    joined = edge[inside[edge] & inside[edge + 1]]
    begins[joined] = True
    ends[joined] = True
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a random number for each of its bytes and their places in the word.

    The numbers are mixed from byte and place, not powers of a base, so no two words
    are known beforehand to have equal sums.
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    upto = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=upto[1:])
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], length)
    byte = data[place + np.repeat(begin, length)]
    number = mix(place.astype(np.uint64) * _BASE + mix(np.arange(256, dtype=np.uint64) + np.uint64(1))[byte])
    return mix(np.add.reduceat(number, upto[:-1]) + length.astype(np.uint64))


def sums_of_runs(flags: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How many flags of each text are set."""
    passed = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=passed[1:])
    return passed[upto[1:]] - passed[upto[:-1]]


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles(word: np.ndarray, upto: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` words in a row within each text, and the number of them up to each text.

    A text with fewer words, but some, gives its whole word sequence as one shingle.
    """
    counts = np.diff(upto)
    number = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    total = np.zeros(len(number) + 1, np.int64)
    np.cumsum(number, out=total[1:])
    text = np.repeat(np.arange(len(number)), number)
    at = upto[:-1][text] + (np.arange(total[-1]) - total[:-1][text])
    length = np.minimum(counts, width)[text]
    out = length.astype(np.uint64)
    for k in range(width):
        here = length > k
        step = word[np.where(here, at + k, 0)] if len(word) else np.zeros(len(at), np.uint64)
        out = np.where(here, mix(out * _BASE + step), out)
    return out, total


def distinct(values: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and the number of them up to each text."""
    values, keep = values.copy(), np.ones(len(values), dtype=bool)
    for first, last in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        values[first:last].sort()
    keep[1:] = values[1:] != values[:-1]
    keep[upto[:-1][upto[:-1] < len(values)]] = True
    passed = np.zeros(len(values) + 1, np.int64)
    np.cumsum(keep, out=passed[1:])
    return values[keep], passed[upto]


def shingle_sets(texts: pa.Array, width: int = 5, limit: int = 1 << 19):
    """Per run of texts: number of the first text, distinct shingle hashes, and the number of them up to each text."""
    data, starts = text_bytes(texts)
    for first, last in pieces(starts, limit):
        part = lower(data[starts[first] : starts[last]])
        begin, end, upto = words(part, starts[first : last + 1] - starts[first])
        yield first, *distinct(*shingles(word_hashes(part, begin, end), upto, width))
