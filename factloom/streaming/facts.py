"""Streaming form of the flow: sources arrive, facts follow, profiles of the candidates concerned are made anew.

Parsing, extraction and normalisation are row-local and run on a stream as they are. Only the merge needs a candidate's
facts together, so each micro-batch appends its facts to a table and rebuilds the profiles of the candidates it touches. The
table is cut into buckets by candidate, and only the buckets that a batch touches are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import confidence, extract, merge
from ..shared import settled
from ..sources import records


def facts_of_stream(sources: DataFrame, default_region: str | None = None) -> DataFrame:
    """Normalised facts of a stream of SOURCE_COLUMNS rows, numbered in their source; records that cannot be read give none."""
    structured, _ = records.parse_structured(sources)
    resumes, _ = records.parse_resumes(sources)
    facts = extract.structured_facts(structured).unionByName(extract.resume_facts(resumes))
    return extract.normalize_facts(facts, default_region)


#: Folders of the table of facts: a small batch reads few of them.
BUCKETS = 256


def profiles_of_batches(facts: DataFrame, facts_path: str, sink: Callable[[DataFrame, int], None], buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer that hands sink(profiles, batch) the scored profiles of the candidates of each batch.

    Facts are written under their batch number, so a batch that is repeated after a failure replaces its own facts.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64("candidate_key"), F.lit(buckets)).cast("int"))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{facts_path}/batch={number}")
        now = spark.read.schema(placed.schema).parquet(f"{facts_path}/batch={number}")
        fresh = now.select("candidate_key").distinct()
        touched_buckets = [r["bucket"] for r in now.select("bucket").distinct().collect()]  # as many as there are buckets at most
        known = spark.read.option("basePath", facts_path).parquet(facts_path).where(F.col("bucket").isin(touched_buckets) & (F.col("batch") <= number)).drop("batch", "bucket")
        touched = extract.collect_facts(known.join(fresh, "candidate_key", "left_semi"))
        sink(confidence.score_profiles(settled(merge.merge_facts(touched))), number)

    return facts.writeStream.foreachBatch(handle)
