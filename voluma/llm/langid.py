"""Language identification with bit-sliced Bloom filters of n-grams.

Training counts letter n-grams per language over all training rows in Spark.  An n-gram belongs to every language in which it
is about as frequent as in the language where it is most frequent.  Each filter position holds a bit per language, in as many
words as there are 64s of languages, so one lookup of an n-gram (the AND of its positions) returns the mask of all languages
that contain it.  A text's languages get the number of its n-grams that carry their bit, corrected for the filter's false
positives; the largest wins.  Only n-grams with a rate of ``LEAST_RATE`` enter, and no more than 1 / LEAST_RATE can have it, so a
filter is at most 44 % full and its false positives at most 9 %, whatever the corpus and the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, stored

#: Lengths of the n-grams; positions of the filter (a power of two: 8 MB for 64 languages whatever the corpus) and lookups per n-gram.
ORDERS = (3, 4)
POSITIONS, LOOKUPS = 1 << 20, 3
#: An n-gram belongs to a language if its rate there is this part of its highest rate, and if it has this rate there.  Both are
#: relative, so that a language of a single short text is learned too.
RATE_SHARE, LEAST_RATE = 0.4, 5e-6
#: Languages of a filter word.
SLICE = 64
#: Characters handled at once.
CHARS = 1 << 20
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def text_runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHARS characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > CHARS:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: 64-bit keys of the n-grams of all texts, and where each text's begin (one more entry at the end).

    Letters are lowered, everything else is one space; an n-gram holds a space at its first or last place only.
    """
    texts = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    letter = _letter_table()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    before = np.concatenate([[0], np.cumsum(keep)])[begins]
    letter = letter[keep]
    codes = np.where(letter, codes[keep], 32).astype(np.uint64)
    for n in ORDERS:
        size = max(0, len(codes) - n + 1)
        key, inner = np.full(size, n, np.uint64), np.ones(size, bool)
        for i in range(n):
            key = key * np.uint64(0x100000001B3) + codes[i : i + size]
            if 0 < i < n - 1:
                inner &= letter[i : i + size]
        at = np.flatnonzero(inner)
        yield _mixed(key[at]), np.searchsorted(at + 1, before)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams per language, summed over as many rows as fit."""
    pending: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0

    def summed(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*pending[lang]))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.add.reduceat(counts, starts)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang in pending:
            keys, counts = summed(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "ngram", "n"])
        pending.clear()

    for batch in batches:
        frame = pd.DataFrame({"lang": batch.column(0).to_pylist(), "text": batch.column(1).to_pylist()})
        for lang, rows in frame.groupby("lang")["text"]:
            texts = rows.tolist()
            for first, last in text_runs(texts):
                for keys, _ in ngrams(texts[first:last]):
                    found = np.unique(keys, return_counts=True)
                    if len(found[0]):
                        pending.setdefault(lang, []).append(found)
                        held += len(found[0])
                if held > 3_000_000:
                    for x in pending:
                        pending[x] = [summed(x)]
                    held = sum(len(x[0][0]) for x in pending.values())
                    if held > 1_500_000:
                        yield from flush()
                        held = 0
    yield from flush()


class LanguageFilters:
    """Bit-sliced Bloom filters: bit i % 64 of ``words[i // 64, p]`` is set if position p is set in the filter of language i."""

    def __init__(self, languages: list[str], words: np.ndarray):
        self.languages, self.words = languages, words
        fill = np.array([np.count_nonzero(words[i // SLICE] >> np.uint64(i % SLICE) & np.uint64(1)) for i in range(len(languages))]) / POSITIONS
        self.false = fill**LOOKUPS

    @staticmethod
    def positions(keys: np.ndarray) -> list[np.ndarray]:
        step = (keys >> np.uint64(32)) | np.uint64(1)
        return [((keys + np.uint64(i) * step) & np.uint64(POSITIONS - 1)).astype(np.int64) for i in range(LOOKUPS)]

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """Which languages contain each n-gram: a row of words per slice."""
        out = np.full((len(self.words), len(keys)), ~np.uint64(0))
        for at in self.positions(keys):
            out &= self.words[:, at]
        return out

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (its part of all corrected counts) of each text with a letter."""
        hits, total = np.zeros((len(self.languages), len(texts))), np.zeros(len(texts))
        for keys, begins in ngrams(texts):
            masks = self.masks(keys)
            total += np.diff(begins)
            for i in range(len(self.languages)):
                bits = np.concatenate([[0], np.cumsum((masks[i // SLICE] >> np.uint64(i % SLICE)) & np.uint64(1))])
                hits[i] += bits[begins[1:]].astype(float) - bits[begins[:-1]]
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        false = self.false[:, None]
        right = np.maximum(0, (hits - total * false) / (1 - false))
        best = np.where(right.sum(axis=0) > 0, right.argmax(axis=0), hits.argmax(axis=0))
        score = right[best, np.arange(len(texts))] / np.maximum(right.sum(axis=0), 1e-12)
        names = [self.languages[i] if n else UNKNOWN for i, n in zip(best, total)]
        return names, np.where(total > 0, np.minimum(score, 1), 0.0)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageFilters:
    """Filters from all rows with a language and a text; without any, no language is ever told.

    The driver gets the languages with their totals and the filter words: 8 MB for every 64 languages, whatever the corpus.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_counter, "lang string, ngram long, n long").groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    counts = stored(counted, "ngrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    words = np.zeros((-(-len(languages) // SLICE), POSITIONS), np.uint64)
    if not languages:
        return LanguageFilters(languages, words)
    table = docs.sparkSession.createDataFrame([(k, i, totals[k]) for i, k in enumerate(languages)], "lang string, i int, total long")
    rated = counts.join(F.broadcast(table), "lang").select("ngram", "i", "n", (F.col("n") / F.col("total")).alias("rate"))  # a row per language
    rated = rated.where(F.col("rate") >= LEAST_RATE)
    own = rated.groupBy("ngram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("i", "rate")).alias("each"))  # a language at most once
    held = own.select("ngram", "top", F.explode("each").alias("e")).where(F.col("e.rate") >= RATE_SHARE * F.col("top"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("e.i") % SLICE)
    mask = held.groupBy("ngram", F.floor(F.col("e.i") / SLICE).cast("int").alias("slice")).agg(F.bit_or(bit).alias("mask"))
    placed = mask.select("ngram", "slice", "mask").mapInArrow(_positions, "slice int, position int, mask long")
    placed = placed.groupBy("slice", "position").agg(F.bit_or("mask").alias("mask")).toArrow()  # POSITIONS rows a slice at most
    at = tuple(placed.column(c).to_numpy() for c in ("slice", "position"))
    words[at] = placed.column("mask").to_numpy().view(np.uint64)
    return LanguageFilters(languages, words)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy().view(np.uint64)
        for at in LanguageFilters.positions(keys):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at.astype(np.int32)), batch.column(2)], ["slice", "position", "mask"])


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", into: str = "language") -> DataFrame:
    """Every row of ``docs`` with one more column ``into``: lang_pred (``und`` for null or letterless text) and score (0 to 1).

    Rows are independent: repeated rows and ties give equal results (equal counts: the first language by name), an empty table
    gives none, and whole texts of any length are read.  A column already named ``into`` is replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.words))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = LanguageFilters(*model.value)
        for batch in batches:
            texts = batch.tolist()
            names, scores = [], []
            for first, last in text_runs(texts):
                found = own.decide(texts[first:last])
                names += found[0]
                scores += found[1].tolist()
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    return docs.withColumn(into, F.pandas_udf(run, "lang_pred string, score double")(F.coalesce(F.col(text_col), F.lit(""))))


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept from training: by the checksum of its id as text; a row without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def known_language(docs: DataFrame, filters: LanguageFilters, least_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose language is told: not ``und``, with a score of ``least_score`` at least.

    Null, empty and letterless texts go; repeated rows stay or go together; an empty table gives none.
    """
    into = fresh("_language", docs.columns)
    found = identify(docs, filters, text_col, into)
    return found.where((F.col(f"{into}.lang_pred") != UNKNOWN) & (F.col(f"{into}.score") >= least_score)).select(*docs.columns)
