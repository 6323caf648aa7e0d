"""The whole flow for a batch of candidates: sources, facts, profiles, confidence, projection, with errors beside.

Stages are narrow but for one shuffle on candidate_key. Facts, profiles and outputs are written to the shared folder once,
and everything that a run returns comes from there. A failure that concerns one candidate becomes a row of errors and
leaves the others alone. Extractors, the merge policy and the scorer are parameters: functions from DataFrame to DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import SKILLS
from ..operators import confidence, extract, merge, validate
from ..operators.project import ProjectionConfig, config_issues, project
from ..shared import settled, written
from ..sources import records

STAGES = (
    "load_runtime_config", "validate_config", "load_ats_json", "load_resume_pdf", "validate_sources", "extract_candidate_facts", "normalize_candidate_facts", "merge_canonical_profile",
    "compute_confidence", "validate_canonical_profile", "project_output", "validate_projected_output", "emit_json",
)
#: Parsed rows of a kind to facts (extract.FACT_COLUMNS). A kind without an extractor gives no facts.
EXTRACTORS: Mapping[str, Callable[[DataFrame], DataFrame]] = {records.STRUCTURED: extract.structured_facts, records.RESUME: extract.resume_facts}


@dataclass
class Stage:
    """Stages that run in one job share its times. rows: what the stage handed on, where a table holds it."""

    name: str
    status: str
    started: datetime
    ended: datetime
    rows: int | None = None

    @property
    def milliseconds(self) -> float:
        return (self.ended - self.started).total_seconds() * 1000


@dataclass
class Result:
    facts: DataFrame
    normalized: DataFrame
    profiles: DataFrame
    outputs: DataFrame
    errors: DataFrame
    stages: list[Stage] = field(default_factory=list)

    def counters(self) -> dict[str, int]:
        """Facts, profiles, outputs and errors: counts of written tables, but for the errors of sources, which are parsed again."""
        return {"facts_extracted": self.facts.count(), "facts_normalized": self.normalized.count(), "profiles": self.profiles.count(), "outputs": self.outputs.count(), "errors": self.errors.count()}


def facts_of(sources: DataFrame, extractors: Mapping[str, Callable[[DataFrame], DataFrame]] = EXTRACTORS) -> tuple[DataFrame, DataFrame]:
    """Facts of all sources (SOURCE_COLUMNS), and the errors of those that cannot be read."""
    loaded, facts, errors = [], [], []
    for kind, parse in ((records.STRUCTURED, records.parse_structured), (records.RESUME, records.parse_resumes)):
        good, bad = parse(sources)
        loaded.append(good.select("candidate_key"))
        taken, refused = extract.checked_payloads(good, kind)
        errors += [bad, refused]
        if kind in extractors:
            facts.append(extractors[kind](taken))
    errors.append(records.missing_sources(sources, loaded[0].unionByName(loaded[1])))
    every = errors[0]
    for more in errors[1:]:
        every = every.unionByName(more)
    return extract.collect_facts(*facts), every


def run(
    sources: DataFrame,
    config: ProjectionConfig,
    default_region: str | None = None,
    strict_null: bool = True,
    merge_options: dict | None = None,
    synonyms: Mapping[str, str] = SKILLS,
    extractors: Mapping[str, Callable[[DataFrame], DataFrame]] = EXTRACTORS,
    merge_policy: Callable[..., DataFrame] = merge.merge_facts,
    scorer: Callable[[DataFrame], DataFrame] = confidence.score_profiles,
) -> Result:
    """sources: SOURCE_COLUMNS. The configuration is checked before anything is read; facts, profiles and outputs are then made and written."""
    stages: list[Stage] = []

    def staged(names: tuple[str, ...], made):
        began = datetime.now(UTC)
        out = made()
        stages.extend(Stage(n, "ok", began, datetime.now(UTC)) for n in names)
        return out

    issues = staged(STAGES[:2], lambda: config_issues(config))
    if issues:
        raise ValueError(f"PIPELINE_CONFIG_INVALID: {issues}")
    facts, errors = facts_of(sources, extractors)
    normalized = staged(STAGES[2:7], lambda: written(extract.normalize_facts(facts, default_region, synonyms), "facts"))
    scored = lambda: settled(scorer(settled(merge_policy(normalized, **(merge_options or {})))))
    profiles, bad = staged(STAGES[7:10], lambda: validate.split_profiles(scored(), lambda df: written(df, "profiles")))
    projected = lambda: settled(project(profiles, config)).withColumn("issues", validate.output_issues(F.col("output"), config, strict_null))
    checked = staged(STAGES[10:12], lambda: written(projected(), "outputs"))
    good = (F.size("errors") == 0) & (F.size("issues") == 0)
    outputs = staged(STAGES[12:], lambda: checked.where(good).select("candidate_key", "output"))
    for stage in stages:
        table = {"normalize_candidate_facts": normalized, "validate_canonical_profile": profiles, "emit_json": outputs}.get(stage.name)
        stage.rows = None if table is None else table.count()
    said = lambda stage, code, text: [F.col("candidate_key"), F.lit(None).cast("string").alias("source_id"), F.lit(stage).alias("stage"), code.alias("code"), text.alias("message")]
    listed = lambda: F.array_join(F.transform("issues", lambda i: F.concat_ws(": ", i["path"], i["reason"])), "; ")
    errors = errors.unionByName(bad.select(*said("validate_canonical_profile", F.lit("VALIDATION_CANONICAL_INVALID"), listed())))
    errors = errors.unionByName(checked.where(F.size("errors") > 0).select(*said("project_output", F.get(F.col("errors"), F.lit(0))["code"], F.get(F.col("errors"), F.lit(0))["path"])))
    errors = errors.unionByName(checked.where((F.size("errors") == 0) & (F.size("issues") > 0)).select(*said("validate_projected_output", F.lit("VALIDATION_PROJECTED_OUTPUT_INVALID"), listed())))
    return Result(normalized.withColumn("value", F.col("original_value")), normalized, profiles, outputs, errors, stages)
