"""Toxicity of whole texts: a bidirectional gated network with attention pooling over all overlapping windows.

A word enters as the mean of two learned vectors: one of the word, by hash, and one of
its character trigrams, by hash. The highest window decides for the text, scaled to
a probability by how the highest windows of labelled texts are distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.buffers import lower, mix, pieces, text_bytes, word_hashes, words
from millrace.llm.language import held_out
from millrace.llm.recurrent import Adam, Network

WINDOW = 48
STRIDE = 32
WORDS = 1 << 13
TRIGRAMS = 1 << 12
WIDTH = 8
HIDDEN = 8
#: About this many labelled texts of either class are read to fit, chosen by a hash; all if there are fewer.
SAMPLE = {1: 700, 0: 2000}
#: Batches at least, rounds over the chosen windows at least, and whether the vectors move. Windows are chosen anew after
#: each phase. Vectors move for a few rounds only, so that on few texts they stay near the evidence they begin with.
PHASES = ((64, 1, False), (1, 5, True), (1, 3, True))
BATCH = 256
SEED = 5
#: What fewer texts of the sample have keeps a zero vector, as has what none has.
LEAST = 3
#: Log-likelihood ratio that counts as 1 in the vectors' first component at the start.
UNIT = 10.0
RUN_BYTES = 1 << 20


class Words:
    """The different words of a run of texts, and which stand where."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        data = lower(data)
        begin, end, self.upto = words(data, starts)
        hashes, first, self.token = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        self.word = (hashes % np.uint64(WORDS)).astype(np.int64)
        length = (end - begin)[first]
        # Each word between two marks; a word of n bytes has n trigrams.
        self.starts = np.cumsum(length) - length
        at = np.arange(length.sum()) - np.repeat(self.starts, length)
        source, last = np.repeat(begin[first], length) + at, np.repeat(length, length) - 1
        left = np.where(at > 0, data[np.maximum(source - 1, 0)], 1)
        right = np.where(at < last, data[np.minimum(source + 1, len(data) - 1)], 2)
        code = left.astype(np.uint64) << np.uint64(16) | data[source].astype(np.uint64) << np.uint64(8) | right.astype(np.uint64)
        self.trigram = (mix(code) % np.uint64(TRIGRAMS)).astype(np.int64)
        self.length = length

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of every window, and the text that it is of; a text without words has none."""
        count = np.diff(self.upto)
        number = np.where(count > 0, 1 + np.maximum(-(-(count - WINDOW) // STRIDE), 0), 0)
        text = np.repeat(np.arange(len(count)), number)
        start = (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * STRIDE
        at = start[:, None] + np.arange(WINDOW)
        inside = at < count[text][:, None]
        return np.where(inside, self.token[np.where(inside, self.upto[:-1][text][:, None] + at, 0)], -1), text


class ToxicityModel:
    def __init__(self):
        self.network = Network(2 * WIDTH, HIDDEN, SEED)
        rng = np.random.default_rng(SEED)
        self.network.p["words"] = (0.02 * rng.standard_normal((WORDS, WIDTH))).astype(np.float32)
        self.network.p["trigrams"] = (0.02 * rng.standard_normal((TRIGRAMS, WIDTH))).astype(np.float32)
        self.scale, self.empty = (1.0, 0.0), 0.0

    def vectors(self, found: Words, which: np.ndarray | None = None) -> np.ndarray:
        p, out = self.network.p, []
        for first in range(0, len(found.word), 50_000):
            last = min(first + 50_000, len(found.word))
            begin = found.starts[first]
            end = found.starts[last - 1] + found.length[last - 1]
            sums = np.add.reduceat(p["trigrams"][found.trigram[begin:end]], found.starts[first:last] - begin)
            out.append(np.concatenate([p["words"][found.word[first:last]], sums / found.length[first:last, None].astype(np.float32)], axis=1))
        return np.concatenate(out)

    def highest(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The highest log-odds of any window of each text; minus infinity without words."""
        best = np.full(len(starts) - 1, -np.inf)
        found = Words(data, starts)
        if len(found.token):
            gates = self.network.projected(self.vectors(found))
            tokens, text = found.windows()
            for first in range(0, len(tokens), 4096):
                part = slice(first, first + 4096)
                np.maximum.at(best, text[part], self.network.forward(gates, tokens[part]))
        return best

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        best = self.highest(data, starts)
        a, b = self.scale
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(a * np.where(np.isfinite(best), best, 0) + b, -30, 30))), self.empty)

    def fit(self, texts: list[str], label: np.ndarray) -> ToxicityModel:
        """From whole texts and their labels (0 or 1).

        A toxic text teaches by one window, first the one whose words and trigrams are
        rarest among clean texts, later the one that the network rates highest; a clean
        text by a few, its worst among them.
        """
        data, starts = text_bytes(pa.array(texts, pa.large_string()))
        found = Words(data, starts)
        tokens, text = found.windows()
        if not len(tokens) or not 0 < label.sum() < len(label):
            self.scale = (0.0, float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1))))
            return self
        rng, p = np.random.default_rng(SEED), self.network.p
        evidence = dict(zip(("words", "trigrams"), self._evidence(found, label), strict=True))
        for name, (ratio, known) in evidence.items():
            p[name][:, 0] = ratio
            p[name] *= known[:, None]
        self.known = {name: known[:, None] for name, (_, known) in evidence.items()}
        guess = self.vectors(found)
        guess = np.append(np.maximum(guess[:, 0], guess[:, WIDTH]), -9)  # the last is padding's
        rating = np.sort(guess[tokens], axis=1)[:, -3:].sum(axis=1)
        adam = Adam(p, 0.01)
        for steps, rounds, moving in PHASES:
            done = 0
            while done < steps or rounds > 0:
                chosen = rng.permutation(self._choose(rating, text, label, rng))
                for k in range(0, len(chosen), BATCH):
                    part = chosen[k : k + BATCH]
                    self._learn(adam, found, tokens[part], label[text[part]], moving)
                    done += 1
                rounds -= 1
            gates = self.network.projected(self.vectors(found))
            rating = np.concatenate([self.network.forward(gates, tokens[k : k + 4096]) for k in range(0, len(tokens), 4096)])
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, text, rating)
        full = np.isfinite(best)
        self.scale = self._scaled(best[full], label[full])
        self.empty = float(label[~full].mean()) if (~full).any() else 0.0
        return self

    @staticmethod
    def _evidence(found: Words, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For words and trigrams: how surely toxic texts have one more often (log-likelihood ratio), and if enough texts have it."""
        text = np.repeat(np.arange(len(found.upto) - 1), np.diff(found.upto))
        pair = np.unique(text * np.int64(len(found.word)) + found.token)
        text, token = pair // len(found.word), pair % len(found.word)
        out = []
        for size, ids, starts, length in (
            (WORDS, found.word, np.arange(len(found.word)), np.ones(len(found.word), np.int64)),
            (TRIGRAMS, found.trigram, found.starts, found.length),
        ):
            n = length[token]
            at = np.repeat(starts[token] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            seen = np.unique(np.repeat(text, n) * np.int64(size) + ids[at])
            toxic = label[seen // size] > 0
            one, zero = np.bincount(seen[toxic] % size, minlength=size), np.bincount(seen[~toxic] % size, minlength=size)
            share = label.mean()
            n = np.maximum(one + zero, 1)
            surprise = one * np.log(np.maximum(one, 1) / n / share) + zero * np.log(np.maximum(zero, 1) / n / (1 - share))
            signed = np.where(one > share * n, surprise, -surprise) / UNIT
            out.append((np.clip(signed, -1, 4).astype(np.float32), one + zero >= LEAST))
        return out

    @staticmethod
    def _choose(rating: np.ndarray, text: np.ndarray, label: np.ndarray, rng) -> np.ndarray:
        order = np.lexsort((-rating, text))
        first = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]
        clean = np.flatnonzero(label[text] == 0)
        return np.unique(np.concatenate([first, rng.choice(clean, min(len(clean), int(label.sum())), replace=False)]))

    def _learn(self, adam: Adam, found: Words, tokens: np.ndarray, label: np.ndarray, moving: bool) -> None:
        """One step on some windows; only their words' vectors are computed, and moved only if ``moving``."""
        p = self.network.p
        used = np.unique(tokens[tokens >= 0])
        place = np.where(tokens >= 0, np.searchsorted(used, tokens), -1)
        length = found.length[used]
        at = np.repeat(found.starts[used] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        ids, owner = found.trigram[at], np.repeat(np.arange(len(used)), length)
        sums = np.add.reduceat(p["trigrams"][ids], np.cumsum(length) - length)
        vectors = np.concatenate([p["words"][found.word[used]], sums / length[:, None].astype(np.float32)], axis=1)
        keep: dict = {}
        logit = self.network.forward(self.network.projected(vectors), place, keep)
        slope = ((1 / (1 + np.exp(-logit)) - label) / len(label)).astype(np.float32)
        grads, d_gates = self.network.backward(keep, place, slope)
        d_vectors = np.zeros_like(vectors)
        live, flat = place.T >= 0, place.T[place.T >= 0]
        for way, d in d_gates.items():
            summed = np.zeros((len(used), d.shape[2]), np.float32)
            np.add.at(summed, flat, d[live])
            grads[f"w{way}"] = vectors.T @ summed
            d_vectors += summed @ p[f"w{way}"].T
        if not moving:  # the network first learns to read the evidence that the vectors begin with
            adam.step(grads)
            return
        grads["words"], grads["trigrams"] = np.zeros_like(p["words"]), np.zeros_like(p["trigrams"])
        np.add.at(grads["words"], found.word[used], d_vectors[:, :WIDTH])
        np.add.at(grads["trigrams"], ids, (d_vectors[:, WIDTH:] / length[:, None])[owner])
        for name, known in self.known.items():
            grads[name] *= known
        adam.step(grads)

    @staticmethod
    def _scaled(best: np.ndarray, label: np.ndarray) -> tuple[float, float]:
        """Slope and offset of the logistic curve through the labels, by Newton steps."""
        x = np.stack([best, np.ones_like(best)], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
            w = w - np.linalg.solve(hessian, x.T @ (q - label) + 1e-2 * (w - [1.0, 0.0]))
        return float(max(w[0], 1e-3)), float(w[1])


def fitted(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """A model of a bounded sample of the labelled rows that are not held out; None without any."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    ).where(~held_out(F.col("doc_id"), 5, 0))
    counted = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, SAMPLE[1] / counted.get(1, 1)).otherwise(SAMPLE[0] / counted.get(0, 1))
    sample = rows.where(u < share)  # a few thousand ids, whatever the number of labels
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id").orderBy("doc_id").toArrow()
    if not found.num_rows:
        return None
    return ToxicityModel().fit(found["text"].to_pylist(), found["toxic"].to_numpy())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``; learns from ``labels(doc_id, toxic)``.

    A doc_id labelled twice is toxic if one label says so. A null, empty or blank text
    gets the toxic share of blank texts among those learned from, 0 if there is none.
    With nothing to learn from every score is 0. Equal texts get equal scores; a null
    doc_id is not held out; no rows give no rows; other columns are not read.
    """
    model = fitted(docs, labels)
    held = held_out(F.col("doc_id"), 5, 0).alias("held_out")
    if model is None:
        score = F.lit(0.0)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def rate(texts: pd.Series) -> pd.Series:
            data, starts = text_bytes(pa.Array.from_pandas(texts, type=pa.large_string()))
            scores = [
                sent.value.score(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]) for a, b in pieces(starts, RUN_BYTES)
            ]
            return pd.Series(np.concatenate(scores) if scores else np.zeros(0))

        score = rate(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select("doc_id", held, score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
