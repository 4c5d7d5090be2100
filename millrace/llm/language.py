"""Language of texts by one Bloom filter whose slots are bit masks over languages.

Every n-gram that is typical of a language sets that language's bit in a few slots;
the bits that all slots of an n-gram share are the languages containing it, for all
languages at once. Per-language counts of bits, less what false positives add, decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.buffers import distinct, mix, pieces, sums_of_runs, text_bytes

GRAMS = (3, 5)
SLOTS = 1 << 19
HASHES = 2
#: The filters are fitted on about this many documents of each language, chosen by a hash; all if there are fewer.
SAMPLE = 1500
#: Documents of a language that an n-gram must be in, and its rate there against the rate in the language it is most usual in.
LEAST = 3
RATIO = 0.3
UNKNOWN = "und"
#: Bytes of text whose n-grams are in memory at a time, and n-grams a fitting task counts before it passes them on.
RUN_BYTES = 1 << 18
HELD_GRAMS = 1 << 21


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def letters(text: Column) -> Column:
    """Lower-case words of letters, with one space before, between and after; null without a letter."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    return F.when(text.rlike(r"\p{L}"), F.concat(F.lit(" "), F.trim(plain), F.lit(" ")))


def _gram_hashes(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of each text, and the number of them up to each text."""
    number = np.maximum(np.diff(starts) - n + 1, 0)
    upto = np.concatenate([[0], np.cumsum(number)])
    value = np.full(max(len(data) - n + 1, 0), n, np.uint64)
    for k in range(n):
        value = (value << np.uint64(8)) | data[k : len(data) - n + 1 + k]
    inside = np.ones(len(value), bool)
    for k in range(1, n):  # n-grams that run over the end of a text
        cut = starts[1:-1] - k
        inside[cut[(cut >= 0) & (cut < len(value))]] = False
    return mix(value[inside]), upto


def _slots(value: np.ndarray, k: int) -> np.ndarray:
    return (mix(value + np.uint64(k + 1)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _texts(texts: pa.Array):
    data, starts = text_bytes(texts)
    for first, last in pieces(starts, RUN_BYTES):
        yield first, last, data[starts[first] : starts[last]], starts[first : last + 1] - starts[first]


def _gram_runs(data: np.ndarray, starts: np.ndarray, n: int):
    """What ``_gram_hashes`` gives, in several runs where one text is longer than RUN_BYTES."""
    if len(starts) > 2 or len(data) <= RUN_BYTES:
        yield _gram_hashes(data, starts, n)
        return
    for begin in range(0, len(data) - n + 1, RUN_BYTES):
        part = data[begin : begin + RUN_BYTES + n - 1]
        yield _gram_hashes(part, np.array([0, len(part)]), n)


class LanguageFilter:
    """Languages, their bits, and the slots."""

    def __init__(self, languages: list[str], slots: np.ndarray):
        self.languages, self.slots = languages, slots
        count = len(languages)
        fill = np.array([((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(count)])
        self.false = fill**HASHES
        if count <= 8:
            self.slots = slots.astype(np.uint8)

    @staticmethod
    def fit(labelled: DataFrame) -> LanguageFilter:
        """From ``labelled(doc_id, letters, lang)`` without nulls; see SAMPLE for how many rows of it are read."""
        counted = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        languages = sorted(counted)
        index = {lang: k for k, lang in enumerate(languages)}
        if not languages:
            return LanguageFilter([], np.zeros((1, SLOTS), np.uint64))
        share = F.coalesce(*[F.when(F.col("lang") == lang, SAMPLE / counted[lang]) for lang in languages], F.lit(0.0))
        u = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = labelled.where(u < share)

        def grams(batches):
            def counted_grams():
                for k, values in found.items():
                    gram, n = np.unique(np.concatenate(values), return_counts=True)
                    yield pa.record_batch(
                        {"lang": pa.array(np.full(len(gram), k, np.int32)), "gram": pa.array(gram.view(np.int64)), "n": pa.array(n)}
                    )

            found: dict[int, list[np.ndarray]] = {}
            held = 0
            for batch in batches:
                lang = np.array([index[x] for x in batch["lang"].to_pylist()], np.int64)
                for first, _, data, starts in _texts(batch["letters"]):
                    for n in GRAMS:
                        runs = [distinct(*run) for run in _gram_runs(data, starts, n)]
                        if len(runs) > 1:  # of one long text
                            value = np.unique(np.concatenate([run[0] for run in runs]))
                            runs = [(value, np.array([0, len(value)]))]
                        for value, upto in runs:
                            held += len(value)
                            for k in range(len(starts) - 1):
                                found.setdefault(int(lang[first + k]), []).append(value[upto[k] : upto[k + 1]])
                    if held > HELD_GRAMS:
                        yield from counted_grams()
                        found, held = {}, 0
            yield from counted_grams()

        counts = sample.select("letters", "lang").mapInArrow(grams, "lang int, gram long, n long")
        counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min(LEAST, max(counted.values(), default=1)))
        size = F.element_at(F.array(*[F.lit(float(min(SAMPLE, counted[x]))) for x in languages]), F.col("lang") + 1)
        rate = F.col("n") / size
        both = counts.groupBy("gram").agg(F.max(rate).alias("top"), F.collect_list(F.struct("lang", rate.alias("rate"))).alias("all"))
        kept = both.select("gram", F.explode(F.filter("all", lambda x: x["rate"] >= RATIO * F.col("top"))).alias("x"))

        def bits(batches):
            for batch in batches:
                value, lang = batch["gram"].to_numpy().view(np.uint64), batch["lang"].to_numpy()
                one = np.left_shift(np.uint64(1), (lang % 64).astype(np.uint64)).view(np.int64)
                yield pa.record_batch(
                    {
                        "word": pa.array(np.tile(lang // 64, HASHES)), "bits": pa.array(np.tile(one, HASHES)),
                        "slot": pa.array(np.concatenate([_slots(value, k) for k in range(HASHES)])),
                    }
                )

        rows = kept.select("gram", "x.lang").mapInArrow(bits, "word int, bits long, slot long")
        rows = rows.groupBy("word", "slot").agg(F.bit_or("bits").alias("bits"))
        slots = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
        filled = rows.toArrow()  # at most SLOTS for every 64 languages
        slots[filled["word"].to_numpy(), filled["slot"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
        return LanguageFilter(languages, slots)

    def shares(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each text and language the share of telling n-grams that the language contains, false positives taken off."""
        count, texts = len(self.languages), len(starts) - 1
        hits, total = np.zeros((texts, count)), np.zeros(texts)
        every = [np.uint64((1 << min(64, count - 64 * w)) - 1) for w in range(len(self.slots))]
        for value, upto in (run for n in GRAMS for run in _gram_runs(data, starts, n)):
            at = [_slots(value, k) for k in range(HASHES)]
            masks = []
            for word in self.slots:
                mask = word[at[0]]
                for a in at[1:]:
                    mask = mask & word[a]
                masks.append(mask)
            some, all_ = np.zeros(len(value), bool), np.ones(len(value), bool)
            for mask, full in zip(masks, every, strict=True):
                some |= mask != 0
                all_ &= mask == full
            telling = some & ~all_ if count > 1 else some
            total += sums_of_runs(telling, upto)
            for k in range(count):
                bit = (masks[k // 64] >> masks[0].dtype.type(k % 64)) & masks[0].dtype.type(1)
                hits[:, k] += sums_of_runs(telling & (bit != 0), upto)
        rate = hits / np.maximum(total, 1)[:, None]
        return np.clip((rate - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lang_id(held_out, lang_pred, score)`` for every row of ``docs(doc_id, text, lang, ...)``.

    Learns from rows that have a language and a letter and are not held out; ``lang`` is
    not read where a language is predicted. A text that is null or has no letter is
    ``und`` with score 0, as is every text if there is nothing to learn from. A text
    whose n-grams tell nothing gets the first language in name order, with score 0.
    Equal texts get equal results; a null doc_id is not held out; no rows give no rows.
    """
    docs = docs.drop("lang_id") if "lang_id" in docs.columns else docs
    held = held_out(F.col("doc_id"), 4, 2)
    text = F.col("text").cast("string")
    labelled = docs.where(F.col("lang").isNotNull() & ~held & text.rlike(r"\p{L}")).select(
        "doc_id", letters(text).alias("letters"), F.col("lang").cast("string").alias("lang")
    )
    found = LanguageFilter.fit(labelled)
    if not found.languages:
        result = F.struct(held.alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
        return docs.withColumn("lang_id", result)
    sent = docs.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(texts: pa.Array) -> pa.Array:
        model = sent.value
        names, scores = [], []
        for _, _, data, starts in _texts(texts):
            share = model.shares(data, starts)
            best = share.argmax(axis=1)
            sharp = share**4
            score = sharp.max(axis=1) / np.maximum(sharp.sum(axis=1), 1e-300)
            empty = np.diff(starts) == 0
            names += [UNKNOWN if e else model.languages[b] for b, e in zip(best.tolist(), empty.tolist(), strict=True)]
            scores += np.where(empty, 0.0, np.clip(score, 0, 1)).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    once = predict.asNondeterministic()  # a filter on it is not pushed below it, which would have each text judged twice
    rows = docs.withColumn("lang_id", once(letters(text)))
    result = F.struct(held.alias("held_out"), F.col("lang_id.lang_pred"), F.col("lang_id.score"))
    return rows.withColumn("lang_id", result)


def accepted(docs: DataFrame) -> DataFrame:
    """``docs`` that have a language, with it in ``lang``; texts without a letter go."""
    rows = identified(docs).where(F.col("lang_id.lang_pred") != UNKNOWN)
    return rows.withColumn("lang", F.col("lang_id.lang_pred")).select(*docs.columns)
