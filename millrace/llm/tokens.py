"""Token ids of whole Arrow batches, encoding each different word of a batch once."""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from millrace.llm.buffers import pieces, text_bytes, word_hashes

#: Words and parts of words whose ids a worker remembers at least; beyond twice as many it lets the others go.
REMEMBERED = 250_000
LONG_WORD = 64
#: Words that are encoded in one call.
CHUNK = 1024
#: Marks that are peeled off a word's end, and what they may be peeled off: letters and digits that the tokenizer keeps
#: as one letter or digit. (Others may end in a combining mark, which goes into one token with the marks behind it.)
_MARKS = ".,;:!?&$#%*|)"
_KEPT = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]$"
#: Bytes of text in work at a time; a longer text is a run alone.
RUN_BYTES = 2 << 20
#: The same in a task, whose worker's memory counts against its executor's.
TASK_RUN_BYTES = 1 << 20


def taken(flat: np.ndarray, upto: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that ``index`` names, one after the other, and the number of entries up to each; list k is
    ``flat[upto[k] : upto[k + 1]]``.
    """
    used = np.diff(upto)[index]
    total = np.concatenate([[0], np.cumsum(used)])
    place = np.repeat(upto[index] - total[:-1], used)
    place += np.arange(total[-1])
    return flat[place], total


def joined(ids: list[bytes], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that ``index`` names, one after the other, and the number of them up to each entry."""
    length = np.array([len(x) // 4 for x in ids], np.int64)
    return taken(np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum(length)]), index)


class Memory:
    """Ids of the words that a worker has met, encoded once.

    Two generations: when the younger is full, the older goes, and words in use are
    taken over, so frequent words stay. Words of over ``LONG_WORD`` characters are not
    kept.
    """

    def __init__(self, encode, limit: int = REMEMBERED):
        self.encode, self.limit = encode, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        """Bytes of the ids, 32 bits each, of each of different words."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found, new = {}, []
        for word in words:
            if word not in young:
                if word in old:
                    young[word] = old[word]
                else:
                    new.append(word)
        for first in range(0, len(new), CHUNK):
            some = new[first : first + CHUNK]
            for word, ids in zip(some, self.encode(some), strict=True):
                (young if len(word) <= LONG_WORD else found)[word] = array("I", ids).tobytes()
        return [young[w] if w in young else found[w] for w in words] if found else [young[w] for w in words]


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, 0 for an empty one."""
    data, starts = text_bytes(words)
    full = np.flatnonzero(np.diff(starts))
    out = np.zeros(len(words), np.uint64)
    out[full] = word_hashes(data, starts[:-1][full], starts[1:][full])
    return out


class Lexicon:
    """Ids of the words that a worker has met, as flat arrays: some 70 bytes for a word of 8 characters and 5 ids.

    Words are found by binary search among their hashes, and compared, so a run costs
    what its own words do. When it is full, the half that was used last stays. Words of
    over ``LONG_WORD`` characters are not kept.
    """

    def __init__(self, encode, limit: int = REMEMBERED):
        self.encode, self.limit = encode, limit
        self.words = pa.array([], pa.large_string())
        self.flat, self.upto = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.last = np.zeros(0, np.int32)
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # in order of the hashes
        self.run = 0

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``flat, upto, at``: word k has the ids ``flat[upto[at[k]] : upto[at[k] + 1]]``."""
        self.run += 1
        hashes = _hashes(words)
        at = self._found(words, hashes)
        missing = np.flatnonzero(at < 0)
        self.last[at[at >= 0]] = self.run
        new, ids, length = words.take(pa.array(missing)), array("I"), []
        for first in range(0, len(new), CHUNK):
            for one in self.encode(new.slice(first, CHUNK).to_pylist()):
                ids.extend(one)
                length.append(len(one))
        at[missing] = len(self.words) + np.arange(len(missing))
        flat = np.concatenate([self.flat, np.frombuffer(ids, "<u4")])
        upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(length, dtype=np.int64)])
        self._remember(new, hashes[missing], flat, upto)
        return flat, upto, at

    def _found(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each word; -1 if it is not kept."""
        at = np.full(len(words), -1, np.int64)
        if not len(self.hashes):
            return at
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        maybe = np.flatnonzero(self.hashes[place] == hashes)
        place = self.places[place[maybe]]
        same = pc.equal(self.words.take(pa.array(place)), words.take(pa.array(maybe))).to_numpy(zero_copy_only=False)
        at[maybe[same]] = place[same]
        return at

    def _remember(self, new: pa.Array, hashes: np.ndarray, flat: np.ndarray, upto: np.ndarray) -> None:
        short = np.flatnonzero(pc.less_equal(pc.utf8_length(new), LONG_WORD).to_numpy(zero_copy_only=False))
        if len(short) < len(new):
            ids, length = taken(flat, upto, len(self.words) + short)
            flat = np.concatenate([self.flat, ids])
            upto = np.concatenate([self.upto, self.upto[-1] + length[1:]])
            new, hashes = new.take(pa.array(short)), hashes[short]
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order], side="right")
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.places = np.insert(self.places, at, len(self.words) + order.astype(np.int32))
        self.words = pa.concat_arrays([self.words, new])
        self.last = np.concatenate([self.last, np.full(len(new), self.run, np.int32)])
        self.flat, self.upto = flat, upto
        if len(self.words) > self.limit:
            self._forget()

    def _forget(self) -> None:
        """The half of the limit that was used last stays."""
        left = np.sort(np.argsort(-self.last, kind="stable")[: self.limit // 2])
        now = np.full(len(self.words), -1, np.int32)
        now[left] = np.arange(len(left))
        stays = now[self.places] >= 0
        self.hashes, self.places = self.hashes[stays], now[self.places[stays]]
        self.words, self.last = self.words.take(pa.array(left)), self.last[left]
        self.flat, self.upto = taken(self.flat, self.upto, left)


def _ends_of(words: pa.Array, cores: pa.Array) -> pa.Array:
    """What each word has behind its core."""
    data, starts = text_bytes(words)
    begin, end = starts[:-1] + pc.binary_length(cores).to_numpy(zero_copy_only=False), starts[1:]
    length = end - begin
    upto = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    rest = data[np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(upto), pa.py_buffer(rest)])


def peeled(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words without the marks at their end, ASCII ones in lower case, and the marks: encoded apart they have the same ids."""
    cores = pc.utf8_rtrim(words, _MARKS)
    cores = pc.if_else(pc.match_substring_regex(cores, _KEPT), cores, words)
    plain = pc.and_(pc.string_is_ascii(cores), pc.invert(pc.match_substring(cores, "<|")))
    return pc.if_else(plain, pc.ascii_lower(cores), cores), _ends_of(words, cores)


class WordEncoder:
    """Encodes texts with a tokenizer whose tokens never cross ASCII white space.

    That holds for tokenizers that drop white space before they split and part letters
    and digits from other marks. A text is cut at ASCII white space, marks are peeled off,
    each different piece is encoded by the tokenizer itself, and the ids are put together
    again by index.
    """

    def __init__(self, path: str, run_bytes: int = RUN_BYTES):
        self.run_bytes = run_bytes
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.lexicon = Lexicon(lambda some: [x.ids for x in tokenizer.encode_batch_fast(some, add_special_tokens=False)])

    def encode(self, texts: pa.Array, end: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per run of texts: number of the first, all ids, and the number of ids up to each text.

        ``end`` is added to every text, if given; a null text is empty.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        _, starts = text_bytes(texts)
        for first, last in pieces(starts, self.run_bytes):
            split = pc.ascii_split_whitespace(texts.slice(first, last - first))
            upto = split.offsets.to_numpy().astype(np.int64)
            upto = 2 * (upto - upto[0])  # a core and marks for each word
            words = split.flatten().dictionary_encode()
            cores, marks = (x.dictionary_encode() for x in peeled(words.dictionary))
            of_core, of_marks = (x.indices.to_numpy(zero_copy_only=False) for x in (cores, marks))
            ids, places, at = self.lexicon.ids(pa.concat_arrays([cores.dictionary, marks.dictionary]))
            index = np.stack([at[of_core], at[len(cores.dictionary) + of_marks]], axis=1)
            index = index[words.indices.to_numpy(zero_copy_only=False)].reshape(-1)
            if end is not None:
                index = np.insert(index, upto[1:], len(places) - 1)
                ids, places = np.append(ids, np.uint32(end)), np.append(places, len(ids) + 1)
                upto = upto + np.arange(len(upto))
            flat, total = taken(ids, places, index)
            del split, words, cores, marks, of_core, of_marks, ids, places, at, index
            pa.default_memory_pool().release_unused()  # a worker is kept for other stages, and so would its memory be
            yield first, flat, total[upto]


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each worker, so that a task finds what the ones before it met."""
    return WordEncoder(path, TASK_RUN_BYTES)
