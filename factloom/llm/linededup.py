"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

State: a reference-count table (shard, h1, h2, refs) has for each line key, by its 128-bit digest, the number of documents
that hold it. Documents are added or deleted by adding or subtracting their counts, so every change can be undone. A
cuckoo filter for each shard holds the keys that have reached the threshold; a key that falls below it again is deleted
from its filter. Filters answer where lines are read; keys that a filter reports but the table denies (its false
positives) are found by passing the table itself through the filters, so answers are exact.

A line's key: the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Lines whose keys have at least
min_chars code points and occur in at least min_docs documents lose all their occurrences.

A filter that a change overfills is built anew, larger, from the table. Filters too large to broadcast stay where they are, and
the digests of lines go to them by shard.

Defined cases: null or empty text is one empty line, and stays; an empty key is never dropped; a very long text is split whole,
and its result is one row; a key counts once for each row that holds it (rows repeated in the table are documents of their
own); counts have no ties to settle; other columns are not read; no rows in, no rows out.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, key_filter, read_table, stored, text_list

SLOTS, KICKS = 4, 500
#: Keys of a shard's filter, about; the number of shards follows the number of keys.
KEYS_PER_SHARD = 1 << 16
SHARDS = 1 << 20
#: Rows that one copy of a shard's filter answers, about.
ROWS_PER_TASK = 1 << 22
REFS_SCHEMA = "h1 long, h2 long, refs long"


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: just the six white-space bytes, and A-Z


def key_digest(key: bytes) -> bytes:
    return hashlib.md5(key, usedforsecurity=False).digest()


class CuckooFilter:
    """Partial-key cuckoo filter: 16-bit fingerprints, four to a bucket, two buckets for each key; supports deletion."""

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (0.85 * SLOTS)))))
            table = np.zeros((buckets, SLOTS), np.uint16)
        self.table, self.mask = table, len(table) - 1

    @staticmethod
    def _mix(fp):
        return (np.asarray(fp, np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(33)

    def places(self, h2: np.ndarray):
        """Fingerprints and both buckets of keys, from the second half of their digests."""
        h = np.asarray(h2).astype(np.int64).view(np.uint64)
        fp = (h & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        first = (h >> np.uint64(16)) & np.uint64(self.mask)
        return fp, first.astype(np.int64), ((first ^ self._mix(fp)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, h2: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(h2)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def insert(self, h2: np.ndarray) -> bool:
        """Insert keys; False if the table is too full, and the caller then builds a larger one."""
        for fp, a, b in zip(*(x.tolist() for x in self.places(h2)), strict=True):
            at = a
            for place in (a, b):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = fp
                    break
            else:
                for kick in range(KICKS):
                    slot = (kick * 7 + fp) % SLOTS
                    fp, self.table[at, slot] = int(self.table[at, slot]), fp
                    at = (at ^ int(self._mix(fp))) & self.mask
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, h2: np.ndarray) -> None:
        """Delete keys that were inserted."""
        for fp, a, b in zip(*(x.tolist() for x in self.places(h2)), strict=True):
            for place in (a, b):
                held = np.flatnonzero(self.table[place] == fp)
                if len(held):
                    self.table[place, held[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())


def filter_of(h2: np.ndarray) -> CuckooFilter:
    capacity = len(h2)
    while True:
        made = CuckooFilter(capacity)
        if made.insert(h2):
            return made
        capacity = 2 * max(capacity, SLOTS)


def _count_lines(min_chars: int):
    def run(batches):
        for batch in batches:
            found: Counter[bytes] = Counter()
            for text in text_list(batch.column("text")):
                keys = set(map(line_key, text.encode("utf-8", "surrogatepass").split(b"\n")))
                found.update(k for k in keys if len(k) >= min_chars and (min_chars <= 1 or len(k.decode("utf-8", "surrogatepass")) >= min_chars))
            digests = np.frombuffer(b"".join(map(key_digest, found)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(list(found.values()), pa.int64())], ["h1", "h2", "refs"])

    return run


def reference_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """docs: text. Returns h1, h2, refs: documents that hold the key. Summed where the lines are read first, so a hot line is a row for each batch."""
    return docs.select("text").mapInArrow(_count_lines(min_chars), REFS_SCHEMA).groupBy("h1", "h2").agg(F.sum("refs").alias("refs"))


def added(refs: DataFrame, docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The reference counts after documents come in."""
    return _changed(refs, reference_counts(docs, min_chars))


def deleted(refs: DataFrame, docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The reference counts after documents go; undoes added()."""
    counts = reference_counts(docs, min_chars)
    return _changed(refs, counts.select("h1", "h2", (-F.col("refs")).alias("refs")))


def _changed(refs: DataFrame, delta: DataFrame) -> DataFrame:
    return refs.select("h1", "h2", "refs").unionByName(delta).groupBy("h1", "h2").agg(F.sum("refs").alias("refs")).where("refs <> 0")


def shard_of(n_shards: int):
    return F.pmod(F.col("h1"), F.lit(n_shards)).cast("int")


def build_filters(refs: DataFrame, min_docs: int, n_shards: int) -> DataFrame:
    """Returns shard, table: the filter of the keys with at least min_docs references."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "table": [filter_of(np.sort(rows["h2"].to_numpy())).to_bytes()]})

    hot = refs.where(F.col("refs") >= min_docs).select(shard_of(n_shards).alias("shard"), "h2")
    return hot.groupBy("shard").applyInPandas(build, "shard int, table binary")


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int, n_shards: int) -> DataFrame:
    """Filters after a change: keys that crossed the threshold upwards are inserted, downwards deleted; others stay untouched."""
    old = before.select("h1", "h2", F.col("refs").alias("old"))
    # Keys that are hot now stand by, for a shard that has to be built anew.
    keys = after.join(old, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("refs", F.lit(0)) >= min_docs).alias("hot"), (F.coalesce("old", F.lit(0)) >= min_docs).alias("was"))
    moved = keys.where("hot or was").select(shard_of(n_shards).alias("shard"), "h2", "hot", "was")

    def change(key: tuple, held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        h2, hot, was = rows["h2"].to_numpy(np.int64), rows["hot"].to_numpy(bool), rows["was"].to_numpy(bool)
        f = CuckooFilter.from_bytes(held["table"].iloc[0]) if len(held) else CuckooFilter(int(hot.sum()))
        f.delete(h2[was & ~hot])
        if not f.insert(h2[hot & ~was]):
            f = filter_of(np.sort(h2[hot]))
        return pd.DataFrame({"shard": [key[0]], "table": [f.to_bytes()]})

    return filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(change, "shard int, table binary")


def _drop_lines(is_hot, min_chars: int, with_text: bool):
    """Rows of kept lines. is_hot: a function from an array of digests (n, 2) to booleans."""

    def run(batches):
        for batch in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in text_list(batch.column("text"))]
            lines = [t.split(b"\n") for t in texts]
            keys = [[line_key(x) for x in ls] for ls in lines]
            distinct = list({k for ks in keys for k in ks if k})
            digests = np.frombuffer(b"".join(map(key_digest, distinct)), np.int64).reshape(-1, 2)
            hot = {k for k, h in zip(distinct, is_hot(digests).tolist() if distinct else [], strict=True) if h and (min_chars <= 1 or len(k.decode("utf-8", "surrogatepass")) >= min_chars)}
            kept = [b"\n".join([x for x, k in zip(ls, ks, strict=True) if k not in hot]) for ls, ks in zip(lines, keys, strict=True)]
            columns = [
                batch.column("doc_id"),
                pa.array([len(ls) for ls in lines], pa.int64()),
                pa.array([sum(k in hot for k in ks) for ks in keys], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                columns.append(pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _probe(filters: dict[int, bytes], n_shards: int, denied: set[tuple[int, int]]):
    """is_hot by filters, less their known false positives."""

    def is_hot(digests: np.ndarray) -> np.ndarray:
        out = np.zeros(len(digests), bool)
        shards = digests[:, 0] % n_shards
        for s in np.unique(shards).tolist():
            if s in filters:
                rows = np.flatnonzero(shards == s)
                table = np.frombuffer(filters[s], np.uint16).reshape(-1, SLOTS)
                out[rows] = CuckooFilter(table=table).contains(digests[rows, 1])
        if denied:
            for i in np.flatnonzero(out).tolist():
                out[i] = (int(digests[i, 0]), int(digests[i, 1])) not in denied
        return out

    return is_hot


def drop_common_lines(docs: DataFrame, refs: DataFrame, min_docs: int = 10, min_chars: int = 1, with_text: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs: doc_id, text; refs: their reference counts, written. Returns doc_id, n_lines, n_dropped, kept_sha256 and, if asked, kept_text.

    The filters go to all executors if their size, known before, is within broadcast_bytes, and so do the keys that they
    report wrongly. Beyond it, lines' digests go to the shards' filters.
    """
    spark, rows = docs.sparkSession, docs.select("doc_id", "text")
    names = "n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {names}"
    n_hot = refs.where(F.col("refs") >= min_docs).count()
    n_shards = max(1, min(SHARDS, n_hot // KEYS_PER_SHARD))
    filters = stored(build_filters(refs, min_docs, n_shards), "line-filters")
    if n_hot * 8 > broadcast_bytes:  # 2 bytes a slot, at worst a quarter of them full
        return _drop_by_shard(rows, refs, filters, n_hot, n_shards, min_docs, min_chars, with_text, schema)
    tables = {r["shard"]: bytes(r["table"]) for r in filters.toLocalIterator()}
    shared = spark.sparkContext.broadcast(tables)

    def false_positives(batches):
        hot = _probe(shared.value, n_shards, set())
        for batch in batches:
            digests = np.stack([batch.column("h1").to_numpy(), batch.column("h2").to_numpy()], 1)
            yield batch.filter(pa.array(hot(digests)))

    wrong = stored(refs.where(F.col("refs") < min_docs).select("h1", "h2").mapInArrow(false_positives, "h1 long, h2 long"), "line-false-positives")
    n_wrong = wrong.count()
    if n_wrong * 200 > broadcast_bytes:
        return _drop_by_shard(rows, refs, filters, n_hot, n_shards, min_docs, min_chars, with_text, schema)
    denied = spark.sparkContext.broadcast({(r["h1"], r["h2"]) for r in wrong.toLocalIterator()})

    def drop(batches):
        yield from _drop_lines(_probe(shared.value, n_shards, denied.value), min_chars, with_text)(batches)

    return rows.mapInArrow(drop, schema)


def _answer(batches):
    """Rows by shard and salt, the filter first. Yields the owners and digests that the filter reports and does not deny."""
    held, is_hot = None, None
    for batch in batches:
        at = np.stack([batch.column("shard").to_numpy(), batch.column("salt").to_numpy()], 1)
        tables, denied = batch.column("table"), batch.column("denied")
        digests = np.stack([batch.column(c).fill_null(0).to_numpy() for c in ("h1", "h2")], 1)
        out, asked = np.zeros(len(at), bool), ~tables.is_valid().to_numpy(zero_copy_only=False)
        # Runs of rows that one filter answers begin with its own row, or with the batch.
        begins = np.unique(np.append(np.flatnonzero(~asked), 0))
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(at)], strict=True):
            if not asked[begin]:
                wrong = np.frombuffer(denied[begin].as_py() or b"", np.int64).reshape(-1, 2).tolist()
                held, is_hot = at[begin].tolist(), _probe({0: tables[begin].as_py()}, 1, set(map(tuple, wrong)))
            mine = begin + np.flatnonzero(asked[begin:end] & (at[begin:end] == held).all(1)) if held else []
            if len(mine):  # rows of a shard without a filter follow some other shard's, and have no hot key
                out[mine] = is_hot(digests[mine])
        yield batch.select(["owner", "h1", "h2"]).filter(pa.array(out))


def ask_filters(filters: DataFrame, asked: DataFrame, loads: DataFrame, n_shards: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """filters: shard, table, denied; asked: owner, h1, h2; loads: shard, n, the rows that will ask it. Returns the rows with a hot key.

    Digests and filters meet in one exchange, and a task streams them past one filter at a time. A shard that more than
    rows_per_task rows ask (a line that very many documents share) has as many copies of its filter as that takes.
    """
    copies = F.broadcast(loads.select("shard", F.ceil(F.col("n") / rows_per_task).cast("int").alias("copies")).where("copies > 1"))  # at most SHARDS rows
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("salt")
    none = F.lit(None)
    answering = filters.join(copies, "shard", "left").select("shard", salts, "table", "denied", none.cast("binary").alias("owner"), none.cast("long").alias("h1"), none.cast("long").alias("h2"))
    salt = F.pmod(F.xxhash64("owner", "h1", "h2"), F.coalesce("copies", F.lit(1))).cast("int").alias("salt")
    asking = asked.withColumn("shard", shard_of(n_shards)).join(copies, "shard", "left").select("shard", salt, none.cast("binary").alias("table"), none.cast("binary").alias("denied"), "owner", "h1", "h2")
    met = answering.unionByName(asking).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("table").isNull())
    return met.mapInArrow(_answer, "owner binary, h1 long, h2 long")


def _drop_by_shard(rows: DataFrame, refs: DataFrame, filters: DataFrame, n_hot: int, n_shards: int, min_docs: int, min_chars: int, with_text: bool, schema: str) -> DataFrame:
    """The way for filters that may not be broadcast: digests go to the filters by shard, hot ones come back to their texts by a shuffle."""

    def digests(batches):
        for batch in batches:
            owners, found = [], []
            for text in set(text_list(batch.column("text"))):
                raw = text.encode("utf-8", "surrogatepass")
                keys = set(map(line_key, raw.split(b"\n"))) - {b""}
                owners += [hashlib.sha256(raw).digest()] * len(keys)
                found += map(key_digest, keys)
            h = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.binary()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["owner", "h1", "h2"])

    def deny(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "denied": [np.ascontiguousarray(held[["h1", "h2"]].to_numpy(np.int64)).tobytes()]})

    shard = shard_of(n_shards).alias("shard")
    cold = refs.where(F.col("refs") < min_docs).select(F.lit(None).cast("binary").alias("owner"), "h1", "h2")
    empty = filters.withColumn("denied", F.lit(None).cast("binary"))
    wrong = ask_filters(empty, cold, stored(refs.groupBy(shard).agg(F.count("*").alias("n")), "line-loads"), n_shards)
    wrong = wrong.withColumn("shard", shard).groupBy("shard").applyInPandas(deny, "shard int, denied binary")
    known = stored(filters.join(wrong, "shard", "left"), "line-denials")

    lines = rows.select("text").mapInArrow(digests, "owner binary, h1 long, h2 long")
    among = key_filter(refs.where(F.col("refs") >= min_docs).select("h2"), n_hot)
    if among is not None:  # digests of lines that cannot be hot need no exchange
        lines = lines.where(among(F.col("h2")))
    hot = ask_filters(known, lines, stored(refs.groupBy(shard).agg(F.sum("refs").alias("n")), "line-loads"), n_shards)
    # A text's hot keys are bounded by the text.
    hot = hot.groupBy("owner").agg(F.collect_set(F.struct("h1", "h2")).alias("hot"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    met = rows.withColumn("owner", F.unhex(F.sha2(raw, 256))).join(hot, "owner", "left").select("doc_id", "text", "hot")

    def drop(batches):
        for batch in batches:
            # A key is hot in every text, so a batch needs one set of them.
            h1, h2 = batch.column("hot").flatten().flatten()
            held = set(zip(h1.to_pylist(), h2.to_pylist(), strict=True))
            is_hot = lambda h, held=held: np.array([(a, b) in held for a, b in h.tolist()], bool)
            yield from _drop_lines(is_hot, min_chars, with_text)([batch])

    return met.mapInArrow(drop, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return drop_common_lines(docs, stored(reference_counts(docs), "line-refs"))


_KEY = r"translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT doc_id, i, l, {_KEY} AS k FROM x),
hot AS (SELECT k FROM k WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.k = hot.k GROUP BY k.doc_id
"""
