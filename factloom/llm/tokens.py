"""Token counts through a digest cache.

Every text is normalised as the tokenizer's own normaliser does (none for byte-level BPE, so the text
itself; null counts as empty) and digested with SHA-256. The cache is a table (version, digest, n_tokens)
in the shared folder; version digests the tokenizer's file. Stored counts are joined on both digests, only
distinct misses are encoded, and their counts are appended to the cache.

Digests and lengths of all rows are written first. Of the rows of a missing digest the smallest doc_id is the one to
encode, and its text is encoded where it is read: the misses' keys go to all executors if small enough. Beyond, a filter of
the keys to encode and one of all others tell where each text belongs, and only texts that both hold are shuffled; with too
many keys for filters, the misses are shuffled.

Defined cases: null text is empty and has no tokens; very long texts are encoded in pieces cut where no
token can cross; equal texts are encoded once (rows that repeat the smallest doc_id too, once a task at most); repeated rows
return repeated rows; null doc_ids are ordinary; an empty table returns no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, by_key, key_filter, read_table, scratch_path, stored

#: Texts above this many characters are cut between a non-space and a single space before a non-space: byte-level
#: pre-tokens never cross there, and no added token holds a blank.
PIECE_CHARS = 1 << 18
CACHE_SCHEMA = "version string, digest binary, n_tokens long"
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, object] = {}


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def pieces(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """The text in pieces of about limit characters; their tokens together are the text's tokens."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def _counter(path: str):
    """A function from a list of texts to their token counts; loaded once for each worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            whole = tok.normalizer is not None  # a normaliser may look across a cut

            def count(texts: list[str]) -> list[int]:
                parts = [[t] if whole else pieces(t) for t in texts]
                got = iter([len(x.ids) for x in tok.encode_batch_fast([p for ps in parts for p in ps], add_special_tokens=False)])
                return [sum(next(got) for _ in ps) for ps in parts]
        else:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)

            def count(texts: list[str]) -> list[int]:
                return [len(x) for x in model.encode(texts, num_threads=1)]

        _loaded[path] = count
    return _loaded[path]


def _encode(path: str, chars: int = 1 << 20):
    def run(batches):
        count, seen = _counter(path), set()
        for batch in batches:
            digests, texts, held = [], [], 0
            n_tokens: list[int] = []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text"), strict=True):
                if digest in seen:
                    continue
                seen.add(digest)
                digests.append(digest)
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= chars:
                    n_tokens += count(texts)
                    texts, held = [], 0
            n_tokens += count(texts)
            if len(seen) > 1_000_000:  # bounded; a digest met again costs its encoding only
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(n_tokens, pa.int64())], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame | None:
    """The cache so far, or None if there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(cache_path)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if folder.getFileSystem(conf).exists(folder) else None


def _chosen(texts: DataFrame, rows: DataFrame, misses: DataFrame, broadcast_bytes: int) -> DataFrame:
    """The rows of texts whose key is among misses; rows: the keys of all texts."""
    key, n = F.struct("doc_id", "digest"), misses.count()
    if n * 128 <= broadcast_bytes:
        return by_key(texts, key, misses, "left_semi", broadcast_bytes)
    others = rows.select(key.alias("key")).distinct()
    others = stored(others.join(misses.toDF("miss"), F.col("key").eqNullSafe(F.col("miss")), "left_anti"), "token-others")
    wanted, unwanted = key_filter(misses, n), key_filter(others, others.count())
    if wanted is None or unwanted is None:
        return texts.join(misses.toDF("miss"), key.eqNullSafe(F.col("miss")), "left_semi")
    # A key is in exactly one of the two tables, so what a filter denies is certain.
    likely = texts.where(wanted(key))
    unsure = likely.where(unwanted(key)).join(misses.toDF("miss"), key.eqNullSafe(F.col("miss")), "left_semi")
    return likely.where(~unwanted(key)).unionByName(unsure)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs: doc_id, text. Returns doc_id, n_bytes, n_tokens, over_limit; appends the misses to the cache."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    rows = stored(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest), "token-rows")
    misses = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = read_cache(spark, cache_path)
    if known is not None:
        known = known.where(F.col("version") == version).select("digest").distinct()
        misses = misses.join(known.hint("shuffle_hash"), "digest", "left_anti")
    misses = stored(misses.select(F.struct("doc_id", "digest").alias("key")), "token-misses")
    texts = _chosen(docs.select("doc_id", text.alias("text"), digest), rows, misses, broadcast_bytes).select("digest", "text")
    encoded = texts.mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    encoded.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-cache"))
