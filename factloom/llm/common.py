"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of white space in the contracts: blank and the five control characters 09 to 0D.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Data go to every executor only below this many bytes, and only after their size is known.
BROADCAST_BYTES = 64 << 20
#: Bits of a filter of row keys, at most (64 MB), and of a segment of it, which one task builds; looks for each key.
FILTER_BITS, SEGMENT_BITS = 1 << 29, 1 << 20
#: Rows and bytes of a batch for a Python worker, where the session does not set them.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_LOOKS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def prepared(spark: SparkSession) -> None:
    """Ships the package, and bounds the batches that Python workers get, since texts may be long; sizes set by the user stay."""
    ship(spark)
    for name, most in BATCH.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, most)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    prepared(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_digest() -> Column:
    """SHA-256 of a document's text; null for null."""
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def keyed(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, text with a key for doc_id that tells rows of one doc_id (or none) but different texts apart.

    Keys are ordered by doc_id (null last), then digest. Operators that hand doc_id through hand the key through.
    """
    key = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("doc_id"), text_digest().alias("digest"))
    return docs.select(key.alias("doc_id"), "text")


def _bits(h: np.ndarray) -> np.ndarray:
    """For each key a row of places in its segment."""
    return ((h.view(np.uint64)[:, None] >> np.uint64(20)) * _LOOKS) >> np.uint64(64 - (SEGMENT_BITS.bit_length() - 1))


def _segment(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    held = np.zeros(SEGMENT_BITS, bool)
    held[_bits(rows["h"].to_numpy())] = True
    return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(held, bitorder="little").tobytes()]})


def key_filter(keys: DataFrame, n: int):
    """keys: one column of n rows. A function from a column to a condition that is false only where the value is not among keys.

    A Bloom filter of 10 bits a key, built by segments and never above FILTER_BITS; None if there are too many keys for it to tell.
    """
    if 3 * n > FILTER_BITS:
        return None
    segments = 1 << min(max(0, (10 * n // SEGMENT_BITS).bit_length()), (FILTER_BITS // SEGMENT_BITS).bit_length() - 1)
    hashed = keys.select(F.xxhash64(keys.columns[0]).alias("h")).withColumn("segment", F.pmod("h", F.lit(segments)).cast("int"))
    table = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for r in hashed.groupBy("segment").applyInPandas(_segment, "segment int, bits binary").toLocalIterator():
        table[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def among(h: pd.Series) -> pd.Series:
        h = h.to_numpy()
        own, places = shared.value, _bits(h)
        at = (h & (len(own) - 1))[:, None]
        return pd.Series(((own[at, places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(1))

    return lambda column: among(F.xxhash64(column))


def by_key(rows: DataFrame, key: Column, keys: DataFrame, how: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows left_semi or left_anti the one column of keys (written, distinct); null equals null. No name can clash.

    Many keys are not broadcast: a filter of them tells which rows to shuffle, and the join of those decides.
    """
    taken, name = {c.lower() for c in rows.columns}, "_key"
    while name in taken:
        name += "_"
    keys = keys.toDF(name)
    n = keys.count()
    if n * 128 <= broadcast_bytes:
        return rows.join(F.broadcast(keys), key.eqNullSafe(F.col(name)), how)
    among = key_filter(keys, n)
    if among is None:
        return rows.join(keys, key.eqNullSafe(F.col(name)), how)
    met = rows.where(among(key)).join(keys, key.eqNullSafe(F.col(name)), how)
    return met if how == "left_semi" else met.unionByName(rows.where(~among(key)))


def by_keys(docs: DataFrame, keys: DataFrame, how: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs left_semi or left_anti the two columns of keys, doc_id and digest of the text; null equals null."""
    keys = keys.toDF("doc_id", "digest").select(F.struct("doc_id", "digest").alias("key")).distinct()
    own = F.struct(F.col("doc_id"), text_digest().alias("digest"))
    return by_key(docs, own, stored(keys, "row-keys"), how, broadcast_bytes)


def text_list(array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in array.to_pylist()]
