"""Confidence of each field of a profile and of the whole, from source reliability, extraction quality and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp01, match_path, mean, round4
from .merge import literal_map

# Reliabilities, qualities, factors and weights.
SOURCE_RELIABILITY = {"ats_json": 0.85, "resume_pdf": 0.7}
EXTRACTION_QUALITY = {"structured_field_map": 0.9, "regex_match": 0.75, "pdf_text_span": 0.6, "heuristic_rule": 0.45}
BASELINE, MULTI_SOURCE, REPEATED, CONFLICT = 0.65, 0.9, 0.5, 0.35
SOURCE_SHARE, METHOD_SHARE, AGREEMENT_SHARE = 0.45, 0.35, 0.2
FIELD_WEIGHTS = {
    "fullname": 0.22,
    "emails[]": 0.2,
    "phones[]": 0.16,
    "skills[].name": 0.14,
    "yearsexperience": 0.1,
    "experience[].company": 0.08,
    "experience[].title": 0.05,
    "education[].institution": 0.05,
}
DEFAULT_WEIGHT = 0.03
# End of fixed values.

_SCORE = ("value", "sourceWeight", "methodWeight", "agreementWeight")


def agreement(n: Column, sources: Column, methods: Column) -> Column:
    """Factor from counts: supporting entries, distinct sources, distinct methods."""
    return (
        F.when(n <= 1, F.lit(BASELINE))
        .when((sources >= 2) & (n == sources) & (methods <= 2), F.lit(MULTI_SOURCE))
        .when((sources == 1) & (n > 1), F.lit(REPEATED))
        .when((n > sources) | (methods >= 3), F.lit(CONFLICT))
        .otherwise(F.lit(BASELINE))
    )


def combined(source: Column, method: Column, agree: Column) -> Column:
    return clamp01(source * SOURCE_SHARE + method * METHOD_SHARE + agree * AGREEMENT_SHARE)


def field_weight(path: Column) -> Column:
    """Exact weight by match path, else that of a known beginning, else the default."""
    m = match_path(path)
    found = F.element_at(literal_map(FIELD_WEIGHTS), m)
    for start in ("emails[]", "phones[]", "skills[].name", "experience[].company", "experience[].title", "education[].institution"):
        found = F.coalesce(found, F.when(m.startswith(start), F.lit(FIELD_WEIGHTS[start])))
    return F.coalesce(found, F.lit(DEFAULT_WEIGHT))


def scorable_fields(profile: str = "") -> Column:
    """Paths of a profile's leaves that have a value, one for each element of a list."""
    c = lambda name: F.col(f"{profile}{name}")
    if_there = lambda value, path: F.when(value.isNotNull(), F.lit(path))
    single = F.array(
        if_there(c("fullName"), "full_name"), if_there(c("headline"), "headline"), if_there(c("yearsExperience"), "years_experience"),
        *(if_there(c("location")[x], f"location.{x}") for x in ("city", "region", "country")), *(if_there(c("links")[x], f"links.{x}") for x in ("linkedin", "github", "portfolio")),
    )
    at = lambda name, i, rest="]": F.concat(F.lit(name + "["), i.cast("string"), F.lit(rest))
    lists = [F.transform(values, lambda _, i: at(n, i, r)) for values, n, r in ((c("emails"), "emails", "]"), (c("phones"), "phones", "]"), (c("links")["other"], "links.other", "]"), (c("skills"), "skills", "].name"))]
    nested = [
        F.transform(c(name), lambda e, i: F.when(e[f].isNotNull(), at(name, i, "]." + f)))
        for name, fields in (("experience", ("company", "title", "start", "end", "summary")), ("education", ("institution", "degree", "field", "endYear")))
        for f in fields
    ]
    return F.array_compact(F.concat(single, *lists, *nested))


def score_profiles(profiles: DataFrame) -> DataFrame:
    """Adds fieldConfidence (by path) and overallConfidence, and each skill's confidence; drops seeds."""
    known = F.transform("provenance", lambda p: F.struct(match_path(p["fieldPath"]).alias("m"), p.alias("p")))
    fields = F.transform(scorable_fields(), lambda f: F.struct(F.collate(f, "UNICODE").alias("k"), f.alias("path"), match_path(f).alias("m")))
    rows = profiles.withColumn("_known", known).withColumn("_fields", F.array_sort(fields))
    entry = lambda x: F.struct(x["p"]["sourceOrder"].alias("o"), x["p"]["sourceId"].alias("s"), x["p"]["method"].alias("t"), x["p"]["sourceKind"].alias("kind"))
    rows = rows.withColumn("_support", F.transform("_fields", lambda f: F.array_sort(F.transform(F.filter("_known", lambda x: x["m"] == f["m"]), entry))))
    seed = lambda path: F.get(F.filter(F.reverse("seeds"), lambda s: s["path"] == path), F.lit(0))["confidence"]

    def parts(f: Column, i: Column) -> Column:
        s = F.get(F.col("_support"), i)
        some = F.size(s) > 0
        source = mean(F.transform(s, lambda x: F.coalesce(F.element_at(literal_map(SOURCE_RELIABILITY), x["kind"]), F.lit(0.0))))
        method = mean(F.transform(s, lambda x: F.coalesce(F.element_at(literal_map(EXTRACTION_QUALITY), x["t"]), F.lit(0.0))))
        agree = agreement(F.size(s), F.size(F.array_distinct(F.transform(s, lambda x: F.struct(x["kind"], x["s"])))), F.size(F.array_distinct(F.transform(s, lambda x: x["t"]))))
        kept = seed(f["path"])  # a fact's base confidence has the same number for each part
        return F.struct(
            f["path"].alias("path"),
            F.when(some, source).otherwise(F.coalesce(kept, F.lit(0.0))).alias("source"),
            F.when(some, method).otherwise(F.coalesce(kept, F.lit(0.0))).alias("method"),
            F.when(some, agree).otherwise(F.coalesce(kept, F.lit(BASELINE))).alias("agree"),
        )

    rows = rows.withColumn("_parts", F.transform("_fields", parts))

    def scored(x: Column) -> Column:
        return F.struct(
            x["path"].alias("fieldPath"),
            F.struct(
                round4(combined(x["source"], x["method"], x["agree"])).alias("value"), F.lit("fixed_weighted").alias("model"), round4(clamp01(x["source"])).alias("sourceWeight"), round4(clamp01(x["method"])).alias("methodWeight"),
                round4(clamp01(x["agree"])).alias("agreementWeight"), F.concat(F.lit("deterministic weighted confidence for "), x["path"]).alias("rationale"),
            ).alias("score"),
        )

    rows = rows.withColumn("fieldConfidence", F.transform("_parts", scored))
    rows = rows.withColumn("_weights", F.transform("fieldConfidence", lambda f: field_weight(f["fieldPath"])))
    total = F.aggregate("_weights", F.lit(0.0), lambda acc, x: acc + x)

    def overall(part: str) -> Column:
        products = F.zip_with("fieldConfidence", "_weights", lambda f, w: f["score"][part] * w)
        return F.when(F.size("fieldConfidence") == 0, F.lit(0.0)).otherwise(round4(clamp01(F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x) / F.when(total <= 0, F.lit(1.0)).otherwise(total))))

    why = F.when(F.size("fieldConfidence") == 0, F.lit("no scorable fields")).otherwise(F.lit("weighted aggregation across important canonical fields"))
    value, source, method, agree = (overall(p).alias(p) for p in _SCORE)
    rows = rows.withColumn("overallConfidence", F.struct(value, F.lit("fixed_weighted").alias("model"), source, method, agree, why.alias("rationale")))
    score_of = lambda i: F.get(F.filter("fieldConfidence", lambda f: f["fieldPath"] == F.concat(F.lit("skills["), i.cast("string"), F.lit("].name"))), F.lit(0))["score"]
    skills = F.transform("skills", lambda s, i: F.struct(s["name"].alias("name"), score_of(i).alias("confidence"), s["sources"].alias("sources")))
    return rows.withColumn("skills", skills).drop("_known", "_fields", "_support", "_parts", "_weights", "seeds")
