"""Extraction: source rows to fact rows.

A fact is a row (FACT_COLUMNS): one value of one field path from one source, with how it was found. Facts of a source are
numbered in the order they are found; collected facts are numbered through for each candidate.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import SKILLS as SKILL_NAMES
from ..functions.normalize import by_target_within, target_of
from ..functions.text import NO_TEXTS, WS, bound, collapsed, distinct_ignoring_case, matches, non_empty, trimmed, utf16_length
from ..shared import settled
from ..sources.records import error

FACT_COLUMNS = (
    "candidate_key", "fact_id", "field_path", "source_kind", "source_id", "extraction_method", "original_value", "value", "value_kind", "confidence",
    "source_order", "extraction_order", "extracted_at", "evidence",
)

# Patterns, section names, field mapping and base confidences.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = rf"\+?[0-9](?:[0-9().-]|{WS}){{7,}}[0-9]"
YEAR_OR_MONTH = r"(?i)(?<![A-Za-z0-9_])((19|20)[0-9]{2}|jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)(?![A-Za-z0-9_])"
NAME = rf"[A-Za-z][A-Za-z.'-]*(?:{WS}+[A-Za-z][A-Za-z.'-]*){{1,3}}"
EXPERIENCE = ["experience", "work experience", "professional experience"]
EDUCATION = ["education", "academic background"]
SKILLS = ["skills", "technical skills", "core skills"]
OTHER_SECTIONS = ["project", "projects", "certification", "certifications", "summary"]
NOT_NAMES = ["resume", "curriculum vitae", "contact", "experience", "education", "skills", "summary"]
INSTITUTION = r"(?i)(?<![A-Za-z0-9_])(university|college|school|institute|academy|polytechnic)(?![A-Za-z0-9_])"
MAPPING = [
    ("full_name", ["full_name", "name"]),
    ("emails[0]", ["email"]),
    ("phones[0]", ["phone"]),
    ("experience[0].company", ["current_company"]),
    ("experience[0].title", ["title"]),
]
BASE_CONFIDENCE = {"ats_json": 0.6, "resume_pdf": 0.45}
EXTRACTION_FAILED = {"ats_json": "ATS_EXTRACTION_FAILED", "resume_pdf": "RESUME_EXTRACTION_FAILED"}
METHOD = {"ats_json": "structured_field_map", "resume_pdf": "regex_match"}
# End of fixed values.

_FOUND = "array<struct<path:string,value:string,evidence:string>>"


def lines_of(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda x: x != "")


def name_of(lines: Column) -> Column:
    """The first of the first twelve lines that reads like a name, or null."""
    fits = lambda x: (~F.lower(x).isin(NOT_NAMES)) & (utf16_length(x) <= 80) & matches(x, NAME)
    return F.get(F.filter(F.slice(lines, 1, 12), fits), F.lit(0))


def every_match(text: Column, pattern: str) -> Column:
    """All matches, trimmed, first spellings."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), trimmed)
    return distinct_ignoring_case(F.filter(found, lambda x: x != ""))


def emails_of(text: Column) -> Column:
    return every_match(text, EMAIL)


def phones_of(text: Column) -> Column:
    """Phone-like matches of 10 to 15 digits; a match may cross lines."""
    return F.filter(every_match(text, PHONE), lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(10, 15))


def section(lines: Column, names: list[str]) -> Column:
    """The lines after the first one that is a heading of these names, up to the next heading of any section."""
    none = F.array().cast(NO_TEXTS)

    def after(x: Column, start: Column) -> Column:
        first = start.cast("int") + 1
        stops = F.transform(F.slice(x["headings"], first, F.size(x["headings"])), lambda h: h.isin(EXPERIENCE + EDUCATION + SKILLS + OTHER_SECTIONS))
        size = bound(F.array_position(stops, F.lit(True)).cast("int"), lambda end: F.when(end > 0, end - 1).otherwise(F.size(x["lines"])))
        return F.when(start > 0, F.slice(x["lines"], first, size)).otherwise(none)

    def found(x: Column) -> Column:
        return bound(F.array_position(F.transform(x["headings"], lambda h: h.isin(names)), F.lit(True)), lambda start: after(x, start))

    return bound(lines, lambda own: bound(F.struct(own.alias("lines"), F.transform(own, F.lower).alias("headings")), found))


def blocks_of(lines: Column) -> Column:
    """A section's blocks: since empty lines are gone, one block if there is any line."""
    return bound(lines, lambda own: F.when(F.size(own) > 0, F.array(F.array_join(own, "\n"))).otherwise(F.array().cast(NO_TEXTS)))


def experience_of(lines: Column) -> Column:
    return F.filter(blocks_of(section(lines, EXPERIENCE)), lambda b: b.rlike(YEAR_OR_MONTH))


def institutions_of(lines: Column) -> Column:
    """The first line of the section (its one block) that names an institution."""
    found = F.filter(section(lines, EDUCATION), lambda x: x.rlike(INSTITUTION))
    return F.slice(found, 1, 1)


def skills_of(lines: Column) -> Column:
    tokens = F.split(F.array_join(section(lines, SKILLS), "\n"), "[,;|•\n]", -1)
    clean = F.transform(tokens, lambda x: collapsed(F.regexp_replace(x, r"\A[•*-]+", "")))
    return distinct_ignoring_case(F.filter(clean, lambda x: utf16_length(x).between(2, 48) & x.rlike("[A-Za-z]")))


def _facts(rows: DataFrame, kind: str) -> DataFrame:
    """rows: source columns and found (array of path, value, evidence)."""
    rows = rows.select("candidate_key", "source_id", "source_kind", "source_order", "ingested_at", F.posexplode("found").alias("pos", "f"))
    order = F.col("pos") + 1
    digits = F.when(order < 10000, F.lpad(order.cast("string"), 4, "0")).otherwise(order.cast("string"))
    return rows.select(
        "candidate_key",
        F.concat_ws(":", "source_id", "f.path", digits).alias("fact_id"),
        F.col("f.path").alias("field_path"),
        "source_kind",
        "source_id",
        F.lit(METHOD[kind]).alias("extraction_method"),
        F.col("f.value").alias("original_value"),
        F.col("f.value").alias("value"),
        F.lit("primitive").alias("value_kind"),
        F.lit(BASE_CONFIDENCE[kind]).alias("confidence"),
        F.col("source_order").cast("int").alias("source_order"),
        order.cast("int").alias("extraction_order"),
        F.col("ingested_at").alias("extracted_at"),
        F.col("f.evidence").alias("evidence"),
    )


def checked_payloads(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Parsed rows that the extractor of this kind can take, and error rows of the others: another kind, or a source that is not described."""
    c = lambda ok: F.coalesce(ok, F.lit(False))
    described = c(F.col("source_id") != "") & c(F.col("ingested_at") != "") & F.col("source_order").isNotNull()
    why = F.when(~c(F.col("source_kind") == kind), F.lit(f"{kind}: unsupported source kind")).when(~described, F.lit(f"{kind}: source_id, ingested_at and source_order are required"))
    errors = rows.where(why.isNotNull()).select(*error("extract_candidate_facts", EXTRACTION_FAILED[kind], why))
    return rows.where(why.isNull()), errors


def structured_facts(parsed: DataFrame) -> DataFrame:
    """One fact for each mapped field with a value; the first source field that is not empty wins."""

    def candidate(path: str, fields: list[str]) -> Column:
        values = [non_empty(F.col(f)) for f in fields]
        which = F.coalesce(*(F.when(v.isNotNull(), F.lit(f"ats field {f}")) for v, f in zip(values, fields, strict=True)))
        return F.struct(F.lit(path).alias("path"), F.coalesce(*values).alias("value"), which.alias("evidence"))

    found = F.filter(F.array(*(candidate(p, fs) for p, fs in MAPPING)), lambda x: x["value"].isNotNull())
    return _facts(parsed.withColumn("found", found), "ats_json")


def resume_facts(resumes: DataFrame) -> DataFrame:
    """Facts of resume texts: name, emails, phones, experience, education, skills, in this order."""
    rows = settled(resumes.withColumn("_lines", lines_of(F.col("text"))))
    lists = [
        (F.array_compact(F.array(name_of(F.col("_lines")))), lambda i: F.lit("full_name"), "regex full-name line"),
        (emails_of(F.col("text")), lambda i: F.lit("emails[]"), "regex email"),
        (phones_of(F.col("text")), lambda i: F.lit("phones[]"), "regex phone"),
        (experience_of(F.col("_lines")), lambda i: F.concat(F.lit("experience["), i, F.lit("].summary")), "explicit experience block"),
        (institutions_of(F.col("_lines")), lambda i: F.concat(F.lit("education["), i, F.lit("].institution")), "explicit education institution line"),
        (skills_of(F.col("_lines")), lambda i: F.concat(F.lit("skills["), i, F.lit("].name")), "explicit skills section"),
    ]
    rows = settled(rows.withColumns({f"_l{n}": values for n, (values, _, _) in enumerate(lists)}))

    def named(n: int, path, label: str) -> Column:
        return F.transform(F.col(f"_l{n}"), lambda v, i: F.struct(path(i.cast("string")).alias("path"), v.alias("value"), F.lit(label).alias("evidence")))

    found = F.concat(*(named(n, path, label).cast(_FOUND) for n, (_, path, label) in enumerate(lists)))
    return _facts(rows.withColumn("found", found), "resume_pdf")


def collect_facts(*facts: DataFrame) -> DataFrame:
    """All facts of each candidate, numbered through; fact ids keep their numbers in the source."""
    every = facts[0]
    for more in facts[1:]:
        every = every.unionByName(more)
    icu = lambda c: F.collate(F.col(c), "UNICODE")
    order = Window.partitionBy("candidate_key").orderBy("source_order", icu("source_id"), icu("source_kind"), "extraction_order", icu("field_path"), icu("fact_id"), "fact_id")
    return every.withColumn("extraction_order", F.row_number().over(order))


def normalize_facts(facts: DataFrame, default_region: str | None = None, synonyms: Mapping[str, str] = SKILL_NAMES) -> DataFrame:
    """Each value, of any type, under the normaliser that its path calls for; the original stays."""
    return facts.withColumn("value", by_target_within(target_of(F.col("field_path")), F.col("value"), facts.schema["value"].dataType, default_region, synonyms))
