"""Language identification by bit-sliced Bloom filters of n-grams.

Learning: of the training rows, for each language the per_language rows with the smallest hash of doc_id (a documented bound).
An n-gram of letters belongs to every language whose texts hold it least_count times or more (a parameter that keeps
misspellings and names out). The filters of all languages share one table: row p holds a bit for each language, so one look at
the rows of an n-gram's HASHES places, and an AND of them, returns all languages that contain it.

Prediction: the set bits of each language over the n-grams of the whole text are counted; a count c of n looks becomes
(c - n f) / (1 - f), where f is that filter's rate of false positives (fill ** HASHES). The largest corrected count
decides, ties by code point; the score is the winner's share of all corrected counts.

Defined cases: a very long text goes through in pieces, whole; null text and text without letters give `und` with score 0; without any learnt language all are `und`; rows
of null lang are not learnt from; a text so short that no n-gram is known goes to the most frequent language learnt,
with score 0; repeated rows return repeated rows; other columns are not read; no rows in, no rows out.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, text_list

N, HASHES, BITS_PER_GRAM = 4, 3, 16
PER_LANGUAGE = 1000
#: An n-gram belongs to a language from so many occurrences on.
LEAST_COUNT = 3
#: Characters that are looked up together; a longer text goes through in pieces.
PIECE = 1 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or a blank (32) if it is none."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(x := chr(c))[0] == "L":
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def letters_of(text: str) -> np.ndarray:
    """The text's letters, lower-cased, words apart by one blank, a blank at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.empty(len(points) + 2, np.uint32)
    a[0] = a[-1] = 32
    a[1:-1] = letter_table()[points]
    gap = a == 32
    gap[1:] &= gap[:-1]
    gap[0] = False
    return a[~gap]


def grams_of(letters: np.ndarray, n: int = N) -> np.ndarray:
    """A 64-bit key for each n letters in a row: exact for Latin, Greek and Cyrillic, hashed above 16 bits a letter."""
    size = len(letters) - n + 1
    if size < 1:
        return np.zeros(0, np.uint64)
    a = letters.astype(np.uint64)
    key = np.zeros(size, np.uint64)
    for i in range(n):
        key = (key << np.uint64(16)) ^ a[i : size + i]
    return key


class LanguageFilters:
    """One row of bits for each place; a bit for each language, in words of 64 languages."""

    def __init__(self, languages: list[str], grams: np.ndarray, masks: np.ndarray):
        """masks: for each gram a row of language words."""
        self.languages = languages
        self.words = max(1, -(-len(languages) // 64))
        self.log2 = max(10, int(np.ceil(np.log2(max(1, len(grams)) * BITS_PER_GRAM / HASHES))))
        self.table = np.zeros((1 << self.log2, self.words), np.uint64)
        for f in _FACTORS[:HASHES]:
            for w in range(self.words):
                np.bitwise_or.at(self.table[:, w], self.place(grams, f), masks[:, w])
        fill = np.array([((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false = fill**HASHES

    def place(self, grams: np.ndarray, factor: np.uint64) -> np.ndarray:
        h = grams * factor
        return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.log2)

    def masks(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """The languages that contain each gram, as bits."""
        column = self.table[:, word]
        found = column[self.place(grams, _FACTORS[0])]
        for f in _FACTORS[1:HASHES]:
            found &= column[self.place(grams, f)]
        return found

    def counts(self, letters: np.ndarray) -> tuple[np.ndarray, int]:
        """Set bits of each language over all grams, and the number of grams."""
        counts, looks = np.zeros(len(self.languages)), 0
        for at in range(0, max(1, len(letters) - N + 1), PIECE):
            grams = grams_of(letters[at : at + PIECE + N - 1])
            looks += len(grams)
            for w in range(self.words):
                found = self.masks(grams, w)
                for i in range(64 * w, min(64 * (w + 1), len(self.languages))):
                    counts[i] += np.count_nonzero(found & np.uint64(1 << (i % 64)))
        return counts, looks

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages:
            return "und", 0.0
        letters = letters_of(text)
        if len(letters) <= 1:  # blanks only
            return "und", 0.0
        counts, looks = self.counts(letters)
        right = np.maximum(0.0, (counts - looks * self.false) / (1 - np.minimum(self.false, 0.999)))
        if not right.sum():
            return self.default, 0.0
        best = int(right.argmax())
        return self.languages[best], float(right[best] / right.sum())


def _count_grams(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            grams, counts = np.unique(grams_of(letters_of(batch.column("text")[i].as_py() or "")), return_counts=True)
            lang = batch.column("lang")[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def in_training(doc_id: Column) -> Column:
    """Rows that may be learnt from: crc32 of doc_id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, least_count: int = LEAST_COUNT) -> LanguageFilters:
    """docs: doc_id, text, lang. What comes to the driver is bounded by per_language texts of each language."""
    rows = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).where(F.col("lang").isNotNull() & in_training(F.col("doc_id")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = rows.withColumn("r", rank).where(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("last"), F.count("*").alias("n"))
    last = {r["lang"]: (r["last"], r["n"]) for r in last.toLocalIterator()}
    languages = sorted(last)
    if not languages:
        return LanguageFilters([], np.zeros(0, np.uint64), np.zeros((0, 1), np.uint64))
    of = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(last[lang][0]))])
    chosen = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & in_training(F.col("doc_id")) & (F.xxhash64("doc_id") <= of[F.col("lang")]))
    counts = chosen.mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    kept = counts.where(F.col("n") >= least_count).groupBy("gram").agg(F.collect_list("lang").alias("langs"))  # a language once
    number = {lang: i for i, lang in enumerate(languages)}
    grams, masks = [], []
    for r in kept.toLocalIterator():
        words = [0] * max(1, -(-len(languages) // 64))
        for lang in r["langs"]:
            words[number[lang] // 64] |= 1 << (number[lang] % 64)
        grams.append(r["gram"])
        masks.append(words)
    made = LanguageFilters(languages, np.array(grams, np.int64).view(np.uint64), np.array(masks, np.uint64).reshape(len(grams), -1))
    made.default = max(languages, key=lambda x: (last[x][1], x))
    return made


def predict(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own: LanguageFilters = shared.value
        for batch in batches:
            got = [own.predict(t) for t in text_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", "text")
    out = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
