"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Documents are normalised (every ``[\\x20\\x09-\\x0D]`` deleted) where they are read. Each batch is a chunk: its distinct
   64-bit fingerprints are sorted, cut by owner (the range of the top bits) and sent as Golomb-coded gaps.
2. Each owner decodes its chunks and answers each with a bitmap: bit i says whether the i-th fingerprint of the chunk was
   also sent by another chunk. Repeats inside a chunk are known to the chunk itself.
3. Suspects are rows whose bit is set or that repeat inside their chunk. Their texts are shuffled by digest, after
   each task has compared and dropped its own repeats, and compared byte by byte; the digest never decides alone. Where
   the suspects' ids are too many to broadcast, a filter of them keeps all other texts out of the shuffle.
4. Of equal texts, the row with the most code points in the original stays, then the smallest doc_id (null last), then
   the first row.

Defined cases: null counts as empty; empty texts equal one another; a very long text is hashed and compared whole; rows
repeated with the same doc_id are a group like any other (one row is marked kept; ties of length and doc_id go to the row
read first); other columns are not read; no rows in, no rows out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, BROADCAST_BYTES, by_key, by_keys, keyed, read_table, stored, text_list

#: Fingerprints of one owner, about, so that its task is bounded; and rows of a chunk.
OWNER_ROWS, CHUNK_ROWS = 1 << 21, 1 << 13


def normalise(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, ASCII_SPACE)


def golomb_encode(values: np.ndarray, span: int) -> tuple[bytes, int]:
    """Sorted distinct numbers under span as Golomb-Rice coded gaps; returns the bytes and the parameter (bits of a remainder)."""
    if not len(values):
        return b"", 0
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    r = max(0, int(span // len(values)).bit_length() - 1)
    q = (gaps >> np.uint64(r)).astype(np.int64)
    sizes = q + 1 + r
    ends = np.cumsum(sizes)
    bits = np.zeros(int(ends[-1]), np.uint8)
    starts = ends - sizes
    # q ones, a zero, then r bits of the remainder
    ones = np.repeat(starts, q) + (np.arange(int(q.sum())) - np.repeat(np.cumsum(q) - q, q))
    bits[ones] = 1
    for i in range(r):
        bits[starts + q + 1 + i] = ((gaps >> np.uint64(r - 1 - i)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).tobytes(), r


def golomb_decode(raw: bytes, r: int, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    zeros = np.flatnonzero(bits == 0)
    starts = np.empty(n, np.int64)
    at, z = 0, 0
    ends = np.empty(n, np.int64)
    zero_list = zeros.tolist()
    for i in range(n):  # a quotient ends at the first zero from its start
        while zero_list[z] < at:
            z += 1
        starts[i], ends[i] = at, zero_list[z]
        at = zero_list[z] + 1 + r
    gaps = (ends - starts).astype(np.uint64) << np.uint64(r)
    for i in range(r):
        gaps |= bits[ends + 1 + i].astype(np.uint64) << np.uint64(r - 1 - i)
    return np.cumsum(gaps, dtype=np.uint64)


_FINGERPRINT_SCHEMA = "row long, n_chars long, sha binary, owner int, place int, repeats boolean, chunk long, coded binary, r int, n int"


def _fingerprints(owners: int):
    """Rows of two kinds: one for each document, and one for each chunk and owner (row is null)."""
    width = -(-(1 << 64) // owners)

    def run(batches):
        part, number, row = TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(at, CHUNK_ROWS)
                texts = text_list(batch.column("text"))
                normal = [normalise(t) for t in texts]
                h = np.array([xxhash.xxh3_64_intdigest(x) for x in normal], np.uint64)
                distinct, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
                of = np.array([int(x) // width for x in distinct], np.int64)
                begins = np.searchsorted(of, np.arange(owners))
                place = np.arange(len(distinct)) - begins[of] if len(distinct) else of
                chunk, n = (part << 24) + number, len(texts)
                number += 1
                blobs = [(o, golomb_encode(distinct[b:e] - np.uint64(o * width), width), e - b) for o, b, e in zip(range(owners), begins.tolist(), [*begins.tolist()[1:], len(distinct)], strict=True) if e > b]
                m, null = len(blobs), None
                columns = [
                    pa.array([*range((part << 33) + row, (part << 33) + row + n), *[null] * m], pa.int64()),
                    pa.array([*map(len, texts), *[null] * m], pa.int64()),
                    pa.array([*(hashlib.sha256(x).digest() for x in normal), *[null] * m], pa.binary()),
                    pa.array([*of[inverse].tolist(), *(o for o, _, _ in blobs)], pa.int32()),
                    pa.array([*place[inverse].tolist(), *[null] * m], pa.int32()),
                    pa.array([*(counts[inverse] > 1).tolist(), *[null] * m], pa.bool_()),
                    pa.array([chunk] * (n + m), pa.int64()),
                    pa.array([*[null] * n, *(raw for _, (raw, _), _ in blobs)], pa.binary()),
                    pa.array([*[null] * n, *(r for _, (_, r), _ in blobs)], pa.int32()),
                    pa.array([*[null] * n, *(k for _, _, k in blobs)], pa.int32()),
                ]
                ids = batch.column("doc_id")
                columns.append(pa.concat_arrays([ids, pa.nulls(m, ids.type)]))
                row += n
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_chars", "sha", "owner", "place", "repeats", "chunk", "coded", "r", "n", "doc_id"])

    return run


def _answer(key: tuple, sent: pd.DataFrame) -> pd.DataFrame:
    """An owner's answers: for each chunk a bitmap of its fingerprints that other chunks sent too."""
    lists = [golomb_decode(raw, r, n) for raw, r, n in zip(sent["coded"], sent["r"], sent["n"], strict=True)]
    every = np.concatenate(lists)
    values, counts = np.unique(every, return_counts=True)
    shared = values[counts > 1]
    bitmaps = [np.packbits(np.isin(x, shared, assume_unique=True)).tobytes() for x in lists]
    return pd.DataFrame({"chunk": sent["chunk"], "owner": sent["owner"], "bitmap": bitmaps})


def _compare(final: bool):
    """One row for each digest that a task meets, after comparing every repeat byte by byte with it.

    What a task remembers is bounded: beyond 256 MB of texts it starts afresh; the next level compares what it sends twice.
    """

    def run(batches):
        held: dict[bytes, bytes] = {}
        size = 0
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            texts = (x.as_py() for x in batch.column("normal")) if final else map(normalise, text_list(batch.column("text")))
            for i, text in enumerate(texts):
                digest = batch.column("sha")[i].as_py() if final else hashlib.sha256(text).digest()
                first = held.setdefault(digest, text)
                if first is text:
                    size += len(text)
                    out.append((digest, text))
                elif first != text:
                    raise ValueError("different texts have one SHA-256 digest")
            if size > 256 << 20 and not final:
                held, size = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([b"" if final else t for _, t in out], pa.binary())], ["sha", "normal"])

    return run


def exact_groups(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs: doc_id, text. Returns a row for each: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    owners = max(1, -(-docs.select().count() // OWNER_ROWS))
    both = stored(rows.mapInArrow(_fingerprints(owners), f"{_FINGERPRINT_SCHEMA}, doc_id {kind}"), "fingerprints")
    narrow = both.where("row is not null").select("row", "doc_id", "n_chars", "sha", "owner", "place", "repeats", "chunk")
    answers = both.where("row is null").select("chunk", "owner", "coded", "r", "n").groupBy("owner").applyInPandas(_answer, "chunk long, owner int, bitmap binary")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("place") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), 7 - F.col("place") % 8)) % 2 == 1
    marked = narrow.join(answers.hint("shuffle_hash"), ["chunk", "owner"])
    suspects = stored(marked.where(F.col("repeats") | bit).select("row", "doc_id", "n_chars", "sha"), "suspects")

    # Byte verification of the suspects' texts.
    texts = by_key(rows, F.col("doc_id"), stored(suspects.select("doc_id").distinct(), "suspect-ids"), "left_semi", broadcast_bytes).select("text")
    met = texts.mapInArrow(_compare(False), "sha binary, normal binary").repartition("sha").mapInArrow(_compare(True), "sha binary, normal binary").select("sha")

    order = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    groups = suspects.groupBy("sha").agg(F.min(order).alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    verified = stored(groups.join(met, "sha", "left_semi").select("sha", "best.keep_row", "best.keep_id", "group_size"), "exact-groups")
    out = narrow.join(verified, "sha", "left")
    return out.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_row", "row") == F.col("row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that stay, all columns: one of each group; ties of length go to the smallest doc_id (null last), then text digest."""
    found = exact_groups(keyed(docs), broadcast_bytes).where("not kept")
    gone = stored(found.select("doc_id.doc_id", "doc_id.digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("own")).distinct(), "gone")
    out = by_keys(docs, gone.where("not own").select("doc_id", "digest"), "left_anti", broadcast_bytes)
    repeated = gone.where("own").select("doc_id", "digest")
    if not repeated.limit(1).count():
        return out
    # Rows that repeat the doc_id and the text of the one that stays.
    first = by_keys(out, repeated, "left_semi", broadcast_bytes).dropDuplicates(["doc_id", "text"])
    return by_keys(out, repeated, "left_anti", broadcast_bytes).unionByName(first)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
