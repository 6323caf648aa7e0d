"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples: of the labelled training rows, for each class the per_class rows with the smallest hash of doc_id (a documented bound
on what is fitted). Terms: the words of a text and their beginnings of 4 to 6 letters; the vocabulary is the n_terms terms that
tell the classes apart best (chi-squared over the examples), plus one term that counts the words with no term in the
vocabulary, so that density matters. Weights: (1 + ln tf) * idf, in vectors of length 1. The vocabulary is part of what is
fitted: with every term of the examples in it, topics outweigh toxic words (README has the figures).

Index: a posting list (examples and weights) for each term, cut where blocks of BLOCK examples end, with the largest weight
of each block that the list meets. A query's upper bound for a block is the sum of its weights times those. The blocks of
the highest bounds are scored first; of the others those whose bound reaches the k-th best cosine so far, and the rest
are skipped, so the k nearest are exact. Texts of equal vectors are one query.

Score: votes weighted by 1 / (DISTANCE + 1 - cosine), turned into a probability by a logistic curve fitted on the examples,
each against the others, with classes weighted as in all training rows. Evidence: the doc_ids of the nearest examples.

Defined cases: null and wordless texts have the empty vector, whose cosine with any other is 0 and with an empty one 1; a
very long text is read whole, as counts of its words; equal cosines go by the examples' order; labels that repeat for a document count as toxic if one is; null labels are no
labels; without examples every score is 0; without toxic or without clean examples it is the share of toxic ones; a null
doc_id is not held out, and not learnt from; repeated rows return repeated rows; other columns are not read; no rows in, no rows out.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_list

PER_CLASS, N_TERMS, NEIGHBOURS, BLOCK, DISTANCE, EVIDENCE = 2000, 512, 25, 64, 0.02, 3
PREFIXES = (4, 5, 6)
#: A term is in at least so many examples.
LEAST_EXAMPLES = 5
_WORD = re.compile(r"\w+")


def terms_of(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]


def _term_sets(batches):
    for batch in batches:
        for one in range(batch.num_rows):
            text = batch.column("text")[one].as_py() or ""
            found = sorted({t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)})
            label = batch.column("toxic")[one].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.string())], ["toxic", "term"])


class Vectors:
    """Turns texts into term counts."""

    def __init__(self, vocabulary: list[str]):
        self.number = {t: i for i, t in enumerate(vocabulary)}
        self.other = len(vocabulary)
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str) -> dict[int, int]:
        out: Counter[int] = Counter()
        known, get = self.known, self.number.get
        if len(known) > 50_000:
            known.clear()
        for word, n in Counter(_WORD.findall(text.lower())).items():
            terms = known.get(word)
            if terms is None:
                terms = known[word] = tuple(x for x in map(get, terms_of(word)) if x is not None) or (self.other,)
            for t in terms:
                out[t] += n
        return out


class BlockMaxIndex:
    """Posting lists with block maxima over the examples; finds the exact nearest by cosine."""

    def __init__(self, counts: list[dict[int, int]], n_terms: int):
        n = len(counts)
        df = np.bincount([t for c in counts for t in c], minlength=n_terms)
        self.idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
        self.n, self.blocks = n, -(-n // BLOCK)
        vectors = [self.vector(c) for c in counts]
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        ids = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        order = np.lexsort((ids, terms))
        #: Posting lists one after another; those of term t begin at starts[t].
        self.ids, self.weights = ids[order], np.concatenate([np.zeros(0, np.float32), *(w for _, w in vectors)])[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        #: The blocks that each list meets, with the list's largest weight there, likewise.
        cells = terms[order] * max(1, self.blocks) + self.ids // BLOCK
        first = np.flatnonzero(np.diff(cells, prepend=-1))
        self.block_ids, self.maxima = self.ids[first] // BLOCK, np.maximum.reduceat(self.weights, first) if len(first) else self.weights
        self.block_starts = np.searchsorted(terms[order][first], np.arange(n_terms + 1))
        self.empty = np.array([i for i, (t, _) in enumerate(vectors) if not len(t)], np.int64)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter(counts.keys(), np.int64, len(counts))
        weights = (1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))) * self.idf[terms]
        return terms, weights / np.sqrt((weights * weights).sum()) if len(terms) else weights

    def cosines(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """With every example of the marked blocks; 0 elsewhere."""
        out = np.zeros(self.n)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            ids = self.ids[self.starts[t] : self.starts[t + 1]]
            met = blocks[ids // BLOCK]
            out[ids[met]] += w * self.weights[self.starts[t] : self.starts[t + 1]][met]  # an example is in a list once
        return out

    def nearest(self, counts: dict[int, int], k: int, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples; ties go to the smaller number."""
        terms, weights = self.vector(counts)
        if not len(terms):
            at = self.empty[self.empty != leave_out]
            rest = np.setdiff1d(np.arange(self.n), np.append(self.empty, leave_out))
            ids = np.concatenate([at, rest])[:k]
            return ids, np.where(np.isin(ids, at), 1.0, 0.0)
        bounds = np.zeros(self.blocks)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            bounds[self.block_ids[self.block_starts[t] : self.block_starts[t + 1]]] += w * self.maxima[self.block_starts[t] : self.block_starts[t + 1]]
        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bounds, kind="stable")[: -(-(k + 1) // BLOCK) + 1]] = True
        scores = self.cosines(terms, weights, first)
        known = np.repeat(first, BLOCK)[: self.n]
        if leave_out >= 0:
            known[leave_out] = False
        reached = np.sort(scores[known])[-k:]
        least = reached[0] if len(reached) == k else 0.0
        open_ = ~first & (bounds + 1e-5 >= least)
        if open_.any():
            scores += self.cosines(terms, weights, open_)
        known |= np.repeat(open_, BLOCK)[: self.n]
        if leave_out >= 0:
            known[leave_out] = False
        ids = np.flatnonzero(known)
        ids = ids[np.lexsort((ids, -scores[ids]))[:k]]
        return ids, scores[ids]


class Model:
    def __init__(self, vocabulary: list[str], examples: list[tuple[int, int, dict[int, int]]], toxic_rows: int, clean_rows: int, k: int):
        examples.sort(key=lambda e: (e[1], max(e[2], key=lambda t: (t != len(vocabulary), e[2][t], -t), default=-1), e[0]))  # alike in one block
        self.vectors, self.k = Vectors(vocabulary), k
        self.known: dict[tuple, tuple[float, list[int]]] = {}
        self.doc_ids = np.array([e[0] for e in examples], np.int64)
        self.labels = np.array([e[1] for e in examples], np.float64)
        self.prior = toxic_rows / max(1, toxic_rows + clean_rows)
        self.curve = None
        if 0 < self.labels.sum() < len(examples):
            self.index = BlockMaxIndex([e[2] for e in examples], len(vocabulary) + 1)
            votes = np.array([self.vote(*self.index.nearest(e[2], k, i)) for i, e in enumerate(examples)])
            share = self.labels.mean()
            self.curve = logistic(votes, self.labels, np.where(self.labels == 1, self.prior / share, (1 - self.prior) / (1 - share)))

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        weights = 1 / (DISTANCE + 1 - np.clip(cosines, 0, 1))
        return float((weights * self.labels[ids]).sum() / weights.sum()) if len(ids) else self.prior

    def score(self, text: str) -> tuple[float, list[int]]:
        if self.curve is None:
            return float(self.prior), []
        counts = self.vectors.counts(text)
        key = tuple(sorted(counts.items())) if len(counts) > 1 else tuple(counts)  # a vector of one term has length 1 whatever its count
        if key not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            ids, cosines = self.index.nearest(counts, self.k)
            a, b = self.curve
            self.known[key] = float(1 / (1 + np.exp(-(a * self.vote(ids, cosines) + b)))), self.doc_ids[ids[:EVIDENCE]].tolist()
        return self.known[key]


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression, by Newton's method."""
    design, at = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        step = np.linalg.solve((design * (weights * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (weights * (y - p)) - ridge * at)
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def in_training(doc_id) -> Column:
    """Rows that may be learnt from: crc32 of doc_id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, n_terms: int = N_TERMS, k: int = NEIGHBOURS) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. All that comes to the driver is bounded by per_class and n_terms."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(in_training(F.col("doc_id")))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("_id"), "toxic"))  # 2 * per_class rows at most
    found = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    # The vocabulary.
    ones, zeros = (F.sum((F.col("toxic") == y).cast("double")) for y in (1, 0))
    table = found.select("toxic", "text").mapInArrow(_term_sets, "toxic int, term string").groupBy("term").agg(ones.alias("a"), zeros.alias("b")).where(F.col("a") + F.col("b") >= LEAST_EXAMPLES)
    n1, n0 = min(per_class, totals.get(1, 0)), min(per_class, totals.get(0, 0))
    chi = F.pow(F.col("a") * n0 - F.col("b") * n1, 2) / ((F.col("a") + F.col("b")) * (n1 + n0 - F.col("a") - F.col("b")) + 1)
    vocabulary = [r["term"] for r in table.orderBy(chi.desc(), "term").limit(n_terms).collect()]

    def vectors(batches):
        make = Vectors(vocabulary)
        for batch in batches:
            counts = [make.counts(t) for t in text_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic"), pa.array([list(c.items()) for c in counts], pa.map_(pa.int32(), pa.int64()))], ["doc_id", "toxic", "counts"])

    rows = found.mapInArrow(vectors, "doc_id long, toxic int, counts map<int,long>").toLocalIterator()
    examples = {r["doc_id"]: (r["doc_id"], r["toxic"], r["counts"]) for r in rows}
    return Model(vocabulary, list(examples.values()), totals.get(1, 0), totals.get(0, 0), k)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, held_out, score, predicted, evidence (doc_ids of the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own: Model = shared.value
        for batch in batches:
            got = [own.score(t) for t in text_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s for s, _ in got], pa.float64()), pa.array([e for _, e in got], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    rows = docs.select("doc_id", "text")
    out = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, evidence array<long>")
    return out.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
