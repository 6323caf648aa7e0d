"""Benchmark decontamination by a prefix-filtered set join.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A window is window_words consecutive words of an
item (a shorter item is one window). Seen as a set of shingles (shingle_words consecutive words), a window lies in a
document only if all its shingles do, so the necessary prefix in rarity order is its one rarest shingle, by counts over
all documents. Documents probe the prefix shingles only; the shingle's place in the window gives the one place where the
window can begin (positional bound), which must leave room for it before the document's end (length bound); then all words
are compared, exactly, as numbers of the benchmark's own vocabulary.

The benchmark is the stated query set. It goes to all executors in blocks of items whose size is bounded; documents pass
through one block after another, and hits add up.

Defined cases: a very long text is read whole; of equally rare shingles a window's first is its prefix; null or wordless text
has no words and no hits; wordless items have no windows; equal items all count;
null item ids are left out of the digest and the count; repeated rows return repeated rows; no rows in, no rows out;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_list

WINDOW_WORDS, SHINGLE_WORDS = 10, 4
#: Bytes of item texts that go to the executors at once.
BLOCK_BYTES = 8 << 20
#: Candidates of a text that are compared at once, about.
CANDIDATES = 1 << 16
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(c if c in _KEEP else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive numbers (or rows of them); only used to find candidates."""
    h = np.zeros((len(ids) - k + 1, *ids.shape[1:]), np.uint64)
    for i in range(k):
        h = _mix(h * np.uint64(0xBF58476D1CE4E5B9) + ids[i : len(ids) - k + 1 + i].astype(np.uint64))
    return h


class ItemIndex:
    """Distinct windows of a block of items by their rarest shingle, as arrays: about 120 bytes a window while it is built, 60 after."""

    def __init__(self, items: list[tuple[int, str]], window_words: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items if item is not None})
        number = {item: i for i, item in enumerate(self.items)}
        rows, owners = [np.zeros((0, window_words), np.int32)], [np.zeros(0, np.int64)]
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or "")], np.int32)
            if n := min(window_words, len(ids)):
                own = np.zeros((len(ids) - n + 1, window_words), np.int32)
                own[:, :n] = np.lib.stride_tricks.sliding_window_view(ids, n)
                rows.append(own)
                owners.append(np.full(len(own), number.get(item, -1), np.int64))
        #: A row of word numbers for each distinct window; 0 after the end of a short one.
        self.words, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.n = (self.words > 0).sum(1)
        self.k = np.minimum(shingle_words, self.n)
        # The owners of window w are owners[first_owner[w]:first_owner[w + 1]]; items without an id own nothing.
        owner, many = np.concatenate(owners), len(self.items) + 1
        pairs = np.unique(of.ravel()[owner >= 0] * many + owner[owner >= 0])
        self.owners = (pairs % many).astype(np.int32)
        self.first_owner = np.searchsorted(pairs // many, np.arange(len(self.words) + 1))
        #: The windows' shingles, and the sorted hashes of all shingles of each length, to be counted in the documents.
        self.own = np.zeros((len(self.words), max(1, window_words - shingle_words + 1)), np.uint64)
        for n in np.unique(self.n):
            at, k = self.n == n, min(shingle_words, n)
            self.own[at, : n - k + 1] = shingle_hashes(self.words[at].T, k)[: n - k + 1].T
        self.all = {int(k): np.unique(self.own[self._shingles(self.k == k)]) for k in np.unique(self.k)}

    def _shingles(self, of: np.ndarray) -> np.ndarray:
        """Which cells of own are shingles of these windows."""
        return of[:, None] & (np.arange(self.own.shape[1]) <= (self.n - self.k)[:, None])

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "own"}

    def ids(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        words = words_of(text)
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def runs(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Places where k known words stand together."""
        known = ids != 0
        n = len(ids) - k + 1
        if n < 1:
            return np.zeros(0, np.int64)
        together = known[:n].copy()
        for i in range(1, k):
            together &= known[i : n + i]
        return np.flatnonzero(together)

    def found(self, ids: np.ndarray, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of wanted shingles, and their numbers in the sorted list."""
        at = self.runs(ids, k)
        if not len(at):
            return at, at
        h = np.zeros(len(at), np.uint64)
        for i in range(k):
            h = _mix(h * np.uint64(0xBF58476D1CE4E5B9) + ids[at + i].astype(np.uint64))
        to = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        hit = wanted[to] == h
        return at[hit], to[hit]

    def order_by_rarity(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle (ties: the first); counts: of each length, occurrences of the hashes in all."""
        seen = np.full(self.own.shape, np.iinfo(np.int64).max)
        for k, hashes in self.all.items():
            cells = self._shingles(self.k == k)
            seen[cells] = counts[k][np.searchsorted(hashes, self.own[cells])]
        offset, every = seen.argmin(1), np.arange(len(seen))
        occurs = seen[every, offset] > 0  # a window with a shingle that no document has occurs nowhere
        #: Of each length: sorted prefix hashes, the first entry of each, and windows and offsets as entries.
        self.prefix = {}
        for k in self.all:
            windows = np.flatnonzero(occurs & (self.k == k))
            h = self.own[windows, offset[windows]]
            order = np.argsort(h, kind="stable")
            hashes, first = np.unique(h[order], return_index=True)
            if len(hashes):
                self.prefix[k] = hashes, np.append(first, len(h)), windows[order].astype(np.int32), offset[windows][order].astype(np.int32)
        del self.own, self.all

    def match(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of occurring windows, and their items."""
        spans, windows = [], []
        for k, (hashes, first, entries, offsets) in self.prefix.items():
            at, to = self.found(ids, k, hashes)
            many = first[to + 1] - first[to]
            parts = np.flatnonzero(np.diff(np.cumsum(many) // CANDIDATES)) + 1  # candidates compared at once are bounded
            for part in np.split(np.arange(len(at)), parts) if len(at) else []:
                some, ends = many[part], np.cumsum(many[part])
                entry = np.repeat(first[to[part]] - ends + some, some) + np.arange(ends[-1])
                window, begin = entries[entry], np.repeat(at[part], some) - offsets[entry]
                fits = (begin >= 0) & (begin + self.n[window] <= len(ids))
                window, begin = window[fits], begin[fits]
                place = np.arange(self.words.shape[1])
                equal = ids[np.minimum(begin[:, None] + place, len(ids) - 1)] == self.words[window]
                same = (equal | (place >= self.n[window][:, None])).all(1)
                window, begin = window[same], begin[same]
                spans += zip(begin.tolist(), (begin + self.n[window]).tolist(), strict=True)
                windows.append(np.unique(window))
        items: set[int] = set()
        for w in np.unique(np.concatenate(windows)).tolist() if windows else []:
            items.update(self.items[i] for i in self.owners[self.first_owner[w] : self.first_owner[w + 1]])
        return spans, items


def _count(shared):
    def run(batches):
        index: ItemIndex = shared.value
        for batch in batches:
            totals = {k: np.zeros(len(h), np.int64) for k, h in index.all.items()}
            for text in text_list(batch.column("text")):
                ids = index.ids(text)
                for k, h in index.all.items():
                    _, to = index.found(ids, k, h)
                    totals[k] += np.bincount(to, minlength=len(h))
            for k, h in index.all.items():
                some = np.flatnonzero(totals[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(h[some].view(np.int64)), pa.array(totals[k][some])], ["k", "h", "n"])

    return run


def _match(shared, first: bool, last: bool):
    def run(batches):
        index: ItemIndex | None = shared.value if shared else None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            before = [None] * batch.num_rows if first else zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, held in zip(text_list(batch.column("text")), before, strict=True):
                ids = index.ids(text) if index else np.zeros(len(words_of(text)))
                spans, items = index.match(ids) if index else ([], set())
                if held:
                    spans += [(s["b"], s["e"]) for s in held[0]]
                    items |= set(held[1])
                spans = merged(spans)
                out[0].append(len(ids))
                out[1].append(spans)
                out[2].append(sorted(items))
            spans = pa.array([[{"b": b, "e": e} for b, e in s] for s in out[1]], pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())])))
            columns = {"doc_id": batch.column("doc_id")}
            if last:
                digests = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in out[2]]
                n_hit = [sum(e - b for b, e in s) for s in out[1]]
                columns |= {"n_words": pa.array(out[0], pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(map(len, out[2]), pa.int64()), "items_sha256": pa.array(digests, pa.string()), "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_())}
            else:
                columns["text"] = batch.column("text")
            columns |= {"spans": spans, "items": pa.array(out[2], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(set(spans)):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window_words: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of hit words), items."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n_blocks = max(1, -(-2 * size // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    kind = dict(docs.dtypes)["doc_id"]
    held = "spans array<struct<b:long,e:long>>, items array<long>"
    result = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, {held}"
    rows = docs.select("doc_id", "text")
    for b in range(n_blocks):
        index = ItemIndex([(r["item_id"], r["text"]) for r in items.where(block == b).toLocalIterator()], window_words, shingle_words)
        counts = {k: np.zeros(len(h), np.int64) for k, h in index.all.items()}
        if len(index.words):
            shared = spark.sparkContext.broadcast(index)
            # Bounded by the shingles of the block.
            got = docs.select("text").mapInArrow(_count(shared), "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).toPandas()
            for k, rows_of_k in got.groupby("k"):
                counts[k][np.searchsorted(index.all[k], rows_of_k["h"].to_numpy(np.int64).view(np.uint64))] = rows_of_k["n"]
        index.order_by_rarity(counts)
        last = b == n_blocks - 1
        rows = rows.mapInArrow(_match(spark.sparkContext.broadcast(index), b == 0, last), result if last else f"doc_id {kind}, text string, {held}")
    return rows


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wi AS (SELECT item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p, w FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM wi),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dp AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
dg AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM dp),
m AS (SELECT dg.doc_id, dg.p, dg.n, win.item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
