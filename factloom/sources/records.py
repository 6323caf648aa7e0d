"""Sources of candidate records: structured JSON records and resume texts.

Every reader returns rows of SOURCE_COLUMNS; parsing splits them into good rows and rows of ERROR_COLUMNS, so one bad
record never stops a batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS, bound, trimmed
from ..shared import settled

#: candidate_key groups the sources of one person.
SOURCE_COLUMNS = ("candidate_key", "source_id", "source_kind", "source_order", "ingested_at", "text")
ERROR_COLUMNS = ("candidate_key", "source_id", "stage", "code", "message")
STRUCTURED, RESUME = "ats_json", "resume_pdf"
IDS = ("id", "candidate_id")
TEXTS = ("name", "full_name", "email", "phone", "current_company", "title")


def error(stage: str, code: str, message: Column, key: str = "candidate_key", source: str = "source_id") -> list[Column]:
    return [F.col(key).alias("candidate_key"), F.col(source).cast("string").alias("source_id"), F.lit(stage).alias("stage"), F.lit(code).alias("code"), message.alias("message")]


def _described(files: DataFrame, text: Column, kind: str, prefix: str, order: int, ingested_at: str, key: Column | None) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    key = F.regexp_replace(name, r"\.[^.]*\z", "") if key is None else key
    return files.select(key.alias("candidate_key"), F.concat(F.lit(prefix), name).alias("source_id"), F.lit(kind).alias("source_kind"), F.lit(order).alias("source_order"), F.lit(ingested_at).alias("ingested_at"), text.alias("text"))


def read_structured(spark: SparkSession, path: str, ingested_at: str, key: Column | None = None) -> DataFrame:
    """Files with one JSON record each. The key is the file's name without its ending, unless given."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return _described(files, F.col("value"), STRUCTURED, "ats:", 1, ingested_at, key)


def read_resumes(spark: SparkSession, path: str, ingested_at: str, key: Column | None = None) -> DataFrame:
    """Files with one resume text each, as bytes: invalid UTF-8 is replaced, a byte-order mark dropped. A PDF has no text here: see read_pdf_resumes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    is_pdf = F.substring("content", 1, 4) == F.lit(b"%PDF")
    return _described(files, F.when(~is_pdf, decoded(F.col("content"))), RESUME, "resume:", 2, ingested_at, key)


def read_pdf_resumes(spark: SparkSession, path: str, ingested_at: str, to_text, key: Column | None = None) -> DataFrame:
    """PDF files through to_text, a function from bytes to text that the caller brings; files it fails on have null text."""
    @F.pandas_udf("string")
    def convert(contents: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return to_text(raw)
            except Exception:  # the caller's library may raise anything; the file goes to the error rows
                return None

        return contents.map(one)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _described(files, clean_document(convert("content")), RESUME, "resume:", 2, ingested_at, key)


def decoded(content: Column) -> Column:
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\\A\ufeff", "")


def clean_document(text: Column) -> Column:
    """One kind of line end, no NUL, no blanks at line ends, trimmed."""
    lines = F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\x00"), F.lit("")), "\n", -1)
    return trimmed(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, rf"{WS}+\z", "")), "\n"))


def plain_text(text: Column) -> Column:
    """What extraction reads: one kind of line end, no NUL, trimmed."""
    return trimmed(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\x00"), F.lit("")))


def parse_structured(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows with the known keys as columns, and error rows.

    An id must be a text or a number if it is there; the other keys a text, null or absent; unknown keys are dropped.
    """
    rows = settled(sources.where(F.col("source_kind") == STRUCTURED).withColumn("_t", trimmed(F.col("text"))))
    rows = settled(rows.withColumn("_v", F.try_parse_json("_t")))
    rows = settled(rows.withColumns({f"_k_{k}": F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant")) for k in (*IDS, *TEXTS)}))
    kind = lambda k: F.col(f"_k_{k}")
    numeric = r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z"
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    bad_id = lambda k: kind(k).isNotNull() & (kind(k) != "STRING") & ~kind(k).rlike(numeric)
    bad_text = lambda k: kind(k).isNotNull() & ~kind(k).isin("STRING", "VOID")
    wrong = F.array_compact(F.array(*(F.when(bad_id(k), F.lit(k)) for k in IDS), *(F.when(bad_text(k), F.lit(k)) for k in TEXTS)))
    why = (
        F.when(F.col("_t").isNull() | (F.col("_t") == ""), F.lit("ATS input string is empty."))
        .when(F.col("_v").isNull(), F.lit("ATS input is not valid JSON."))
        .when(~is_object, F.lit("ATS input schema validation failed: not an object"))
        .otherwise(bound(wrong, lambda w: F.when(F.size(w) > 0, F.concat(F.lit("ATS input schema validation failed: "), F.array_join(w, ", ")))))
    )
    rows = settled(rows.withColumn("_why", why))
    values = [F.try_variant_get("_v", f"$.{k}", "string").alias(k) for k in (*IDS, *TEXTS)]
    good = rows.where(F.col("_why").isNull()).select("candidate_key", "source_id", "source_kind", "source_order", "ingested_at", *values)
    good = good.withColumn("candidate_reference", F.coalesce("candidate_id", "id"))
    return good, rows.where(F.col("_why").isNotNull()).select(*error("load_ats_json", "ATS_JSON_PARSE_FAILED", F.col("_why")))


def parse_resumes(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows with their text, and error rows: a source without bytes or whose conversion failed."""
    rows = sources.where(F.col("source_kind") == RESUME)
    missing = F.col("text").isNull()
    good = rows.where(~missing).withColumn("text", plain_text(F.col("text")))
    return good, rows.where(missing).select(*error("load_resume_pdf", "RESUME_PDF_PARSE_FAILED", F.lit("Resume has no text: the source is empty, its conversion failed, or it is a PDF and no parser was given.")))


def missing_sources(requested: DataFrame, loaded: DataFrame) -> DataFrame:
    """Error rows of candidates for whom no source was loaded. requested, loaded: candidate_key."""
    gone = requested.select("candidate_key").distinct().join(loaded.select("candidate_key").distinct(), "candidate_key", "left_anti")
    return gone.withColumn("source_id", F.lit(None).cast("string")).select(*error("validate_sources", "PIPELINE_SOURCES_EMPTY", F.lit("No source could be loaded.")))
