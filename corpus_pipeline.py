"""Corpus pipeline: toxicity filter, exact and near dedup, benchmark decontamination, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The last
returns a row for each document kept so far with the number of its words that the mix takes (0: none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontam, exactdedup, mixing, neardedup, toxicity
from factloom.llm.common import read_table, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score of 0.5 or more) go. The model learns from the training rows of labels."""
    scored = toxicity.score(_whole(docs), toxicity.fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.where("predicted = 0").select("doc_id.*")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, one stays."""
    return exactdedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents similar by 0.8 or more on five-word shingles, the one with the smallest doc_id stays."""
    return neardedup.drop_near_duplicates(docs, k=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    found = decontam.decontaminate(_whole(docs), read_table(spark, sf_dir, "benchmark"))
    return found.where("not contaminated").select("doc_id.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, n_slots for every document kept."""
    return mixing.mix(docs)


def _whole(docs: DataFrame) -> DataFrame:
    """docs: any columns with text. Returns doc_id, text with the whole row for doc_id, which the operators hand through: rows are judged where they are."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again as the next one's documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
