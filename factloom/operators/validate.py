"""Validation: issues of profiles and of projected outputs, as arrays of (path, reason) beside each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, matches
from .paths import parse
from .project import ProjectionConfig, config_issues

_ISSUES = "array<struct<path:string,reason:string>>"
_PROVENANCE = "array<struct<fieldPath:string,sourceKind:string,sourceId:string,method:string,sourceOrder:double,recordedAt:string,evidence:string>>"
# Kinds, methods, and shapes from public documents of the formats (what a validator library adds beyond them is not known here).
EMAIL = r"(?!\.)(?!.*\.\.)[A-Za-z0-9_'+.-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}"
URL = r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/?#]+[^\s]*"
E164, YEAR_MONTH, COUNTRY = r"\+[1-9][0-9]{1,14}", r"[0-9]{4}-(0[1-9]|1[0-2])", "[A-Z]{2}"
DATETIME = r"[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})"
FIELD_PATH = r"[A-Za-z_][A-Za-z0-9_]*(\[([0-9]+|\*)?\])?(\.[A-Za-z_][A-Za-z0-9_]*(\[([0-9]+|\*)?\])?)*"
METHODS, KINDS = ["structured_field_map", "pdf_text_span", "regex_match", "heuristic_rule"], ["ats_json", "resume_pdf"]
# End of fixed values.


def issue(bad: Column, path: str, reason: str) -> Column:
    return F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(reason).alias("reason")))


def _each(values: Column, bad, path: str, reason: str) -> Column:
    """Whether any element is bad; the issue names the list."""
    return issue(F.exists(values, bad), path, reason)


def bad_score(s: Column) -> Column:
    numbers = [~F.coalesce(s[p].between(0.0, 1.0), F.lit(False)) for p in ("value", "sourceWeight", "methodWeight", "agreementWeight")]
    return numbers[0] | numbers[1] | numbers[2] | numbers[3] | F.coalesce(s["model"] != "fixed_weighted", F.lit(True)) | (F.coalesce(s["rationale"], F.lit("")) == "")


def bad_provenance(p: Column) -> Column:
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        no(matches(p["fieldPath"], FIELD_PATH)) | no(p["sourceKind"].isin(KINDS)) | no(p["sourceId"] != "") | no(p["method"].isin(METHODS)) | no(p["sourceOrder"] >= 0) | no(matches(p["recordedAt"], DATETIME)) | (F.coalesce(p["evidence"], F.lit("x")) == "")
    )


def profile_issues() -> Column:
    c = F.col
    text = lambda v, path: issue(v == "", path, "empty text")
    wrong = lambda v, pattern: v.isNotNull() & ~matches(v, pattern)
    listed = [
        issue(F.coalesce(c("candidateId"), F.lit("")) == "", "candidateId", "empty text"),
        text(c("fullName"), "fullName"), text(c("headline"), "headline"), text(c("location")["city"], "location.city"), text(c("location")["region"], "location.region"),
        _each(c("emails"), lambda x: ~matches(x, EMAIL), "emails", "not an email"),
        _each(c("phones"), lambda x: ~matches(x, E164), "phones", "not E.164"),
        issue(wrong(c("location")["country"], COUNTRY), "location.country", "not ISO-3166 alpha-2"),
        *(issue(wrong(c("links")[x], URL), f"links.{x}", "not a URL") for x in ("linkedin", "github", "portfolio")),
        _each(c("links")["other"], lambda x: ~matches(x, URL), "links.other", "not a URL"),
        issue(c("yearsExperience") < 0, "yearsExperience", "negative"),
        _each(c("skills"), lambda s: (s["name"] == "") | bad_score(s["confidence"]) | F.exists(s["sources"], bad_provenance), "skills", "bad skill"),
        *(_each(c("experience"), lambda e: wrong(e[f], YEAR_MONTH), f"experience.{f}", "not YYYY-MM") for f in ("start", "end")),
        *(_each(c("experience"), lambda e: e[f] == "", f"experience.{f}", "empty text") for f in ("company", "title", "summary")),
        *(_each(c("education"), lambda e: e[f] == "", f"education.{f}", "empty text") for f in ("institution", "degree", "field")),
        _each(c("education"), lambda e: e["endYear"].isNotNull() & ~(e["endYear"].between(1900, 2100) & (e["endYear"] == F.floor(e["endYear"]))), "education.endYear", "not a year from 1900 to 2100"),
        _each(c("provenance"), bad_provenance, "provenance", "bad provenance"),
        _each(c("fieldConfidence"), lambda f: bad_score(f["score"]) | ~matches(f["fieldPath"], FIELD_PATH), "fieldConfidence", "bad score"),
        issue(bad_score(c("overallConfidence")), "overallConfidence", "bad score"),
    ]
    # An element that no rule can judge (null) is no issue of that rule.
    return F.array_compact(F.array(*listed)).cast(_ISSUES)


def split_profiles(profiles: DataFrame, settle=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Valid profiles, and (candidate_key, issues) of the others. settle keeps the issues from being copied into the filters."""
    rows = settle(profiles.withColumn("issues", profile_issues()))
    return rows.where(F.size("issues") == 0).drop("issues"), rows.where(F.size("issues") > 0).select("candidate_key", "issues")


def output_issues(output: Column, config: ProjectionConfig, strict_null: bool = True) -> Column:
    """Issues of a projected output (JSON). A null that is present fails its type if strict_null; else it counts as missing. The configuration is checked again."""
    if invalid := config_issues(config):
        raise ValueError(f"invalid projection: {invalid}")
    return bound(F.try_parse_json(output), lambda v: _output_issues(v, config, strict_null))


def _output_issues(v: Column, config: ProjectionConfig, strict_null: bool) -> Column:
    found = []
    for f in config.fields:
        where = "$" + "".join(f"[{t}]" if isinstance(t, int) else f".{t}" for t in parse(f.path))
        kind = F.schema_of_variant(F.try_variant_get(v, where, "variant"))
        base = f.type.removesuffix("[]")
        shape = {"string": "STRING", "number": r"(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT<.*>"}[base]
        good = matches(kind, rf"ARRAY<({shape}|VOID|VARIANT)?>" if f.type.endswith("[]") else shape)
        bad = kind.isNotNull() & ~good
        if not strict_null:
            bad = bad & (kind != "VOID")
        found.append(issue(bad, f.path, f"not {f.type}"))
        if f.required:
            found.append(issue(kind.isNull() | (F.lit(not strict_null) & (kind == "VOID")), f.path, "required"))
    if config.include_confidence:
        score = F.try_variant_get(v, "$.overallConfidence", "double")
        found.append(issue(~F.coalesce(score.between(0.0, 1.0), F.lit(False)), "overallConfidence", "not from 0 to 1"))
    if config.include_provenance:
        kind = F.schema_of_variant(F.try_variant_get(v, "$.provenance", "variant"))
        found.append(issue(kind.isNull(), "provenance", "required"))
        listed = F.try_variant_get(v, "$.provenance", _PROVENANCE)
        found.append(issue(kind.isNotNull() & F.coalesce(F.exists(listed, bad_provenance), F.lit(True)), "provenance", "bad provenance"))
    return F.array_compact(F.array(*found)).cast(_ISSUES) if found else F.array().cast(_ISSUES)
