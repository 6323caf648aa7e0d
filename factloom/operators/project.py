"""Projection: a configuration reshapes the profile, with type contracts and a policy for missing values.

A configuration is compiled to Columns once, on the driver. What depends on the row is in the result: the projected JSON
and the list of errors. A field that is missing, null or of another type is handled by the policy.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import BY_DIRECTIVE, DIRECTIVES
from ..shared import settled
from .paths import WILDCARD, PathError, parse, resolve

TYPES = ("string", "number", "boolean", "object", "string[]", "number[]", "boolean[]", "object[]")
POLICIES = ("null", "omit", "error")


@dataclass
class ProjectionField:
    path: str
    type: str
    required: bool = False
    normalize: list[str] = field(default_factory=list)
    source: str | None = None

    @property
    def source_path(self) -> str:
        return self.source if self.source is not None else self.path


@dataclass
class ProjectionConfig:
    fields: list[ProjectionField]
    include_confidence: bool = False
    include_provenance: bool = False
    on_missing: str = "null"


def read_config(raw: dict[str, Any]) -> ProjectionConfig:
    """A configuration from its JSON form; snake_case spellings count, unknown keys are dropped, directives are spelled canonically."""
    either = lambda d, a, b, default: d.get(a, d.get(b, default))
    fields = []
    for f in raw.get("fields") or []:
        mapped = f.get("mapping", "mapped" if f.get("from") is not None else "direct") == "mapped"
        directives = [DIRECTIVES.get(str(d).lower(), d) for d in f.get("normalize") or []]
        fields.append(ProjectionField(f.get("path", ""), f.get("type", ""), bool(f.get("required", False)), directives, f.get("from") if mapped else None))
        fields[-1].mapped_without_source = mapped and f.get("from") is None
        fields[-1].direct_with_source = not mapped and f.get("from") is not None
    return ProjectionConfig(fields, bool(either(raw, "includeConfidence", "include_confidence", False)), bool(either(raw, "includeProvenance", "include_provenance", False)), either(raw, "onMissing", "on_missing", "null"))


def config_issues(config: ProjectionConfig) -> list[tuple[str, str]]:
    """What is wrong with a configuration: (place, reason); empty if it is valid."""
    out = [] if config.fields else [("fields", "At least one projection field is required.")]
    if config.on_missing not in POLICIES:
        out.append(("onMissing", f"unknown policy {config.on_missing!r}"))
    seen: set[str] = set()
    for i, f in enumerate(config.fields):
        for place, path, wildcards in (("path", f.path, False), ("from", f.source, True)):
            if path is None:
                continue
            try:
                if WILDCARD in parse(path) and not wildcards:
                    out.append((f"fields.{i}.{place}", "Wildcard is not allowed in an output path."))
            except PathError as e:
                out.append((f"fields.{i}.{place}", str(e)))
        if f.type not in TYPES:
            out.append((f"fields.{i}.type", f"unknown type {f.type!r}"))
        if getattr(f, "mapped_without_source", False) or getattr(f, "direct_with_source", False):
            out.append((f"fields.{i}.from", "from belongs to mapped fields, and only to them"))
        out += [(f"fields.{i}.normalize", f"unknown directive {d!r}") for d in f.normalize if d not in BY_DIRECTIVE]
        if len(set(f.normalize)) < len(f.normalize):
            out.append((f"fields.{i}.normalize", "Duplicate normalize directive."))
        if f.path in seen:
            out.append((f"fields.{i}.path", "Duplicate projection path."))
        seen.add(f.path)
    return out


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return type_name(kind.elementType) + "[]"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "number" if isinstance(kind, T.NumericType) else "object"


def _under_directives(column: Column, kind: T.DataType, directives: list[str]) -> tuple[Column, T.DataType]:
    for d in directives:
        if isinstance(kind, T.StringType):
            column = BY_DIRECTIVE[d](column)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            column = F.transform(column, lambda x: BY_DIRECTIVE[d](x))
        else:  # no text: unknown to every normaliser
            column, kind = F.lit(None).cast("string"), T.StringType()
    return column, kind


def json_of(value: Column) -> Column:
    """A value as JSON, nulls inside it kept."""
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


@dataclass
class _Leaf:
    json: Column  # null: the key is left out


class _Tree(dict):
    """Properties of an output object, or with lists=True the slots of an output list."""

    lists = False


def _assign(tree: _Tree, path: str, leaf: _Leaf) -> None:
    at: Any = tree
    tokens = parse(path)
    for n, token in enumerate(tokens):
        if isinstance(token, int) != at.lists:
            raise PathError("PATH_TYPE_MISMATCH", path, n)
        if n == len(tokens) - 1:
            at[token] = leaf
            return
        below = at.get(token)
        if not isinstance(below, _Tree):  # a property over a scalar replaces it
            below = at[token] = _Tree()
            below.lists = isinstance(tokens[n + 1], int)
        at = below


def _render(node: _Tree | _Leaf) -> Column:
    """JSON of a node; null if nothing below it is there."""
    if isinstance(node, _Leaf):
        return node.json
    if node.lists:
        slots = [_render(node[i]) if i in node else F.lit(None).cast("string") for i in range(max(node) + 1)]
        some = F.coalesce(*slots).isNotNull()
        return F.when(some, F.concat(F.lit("["), F.array_join(F.array(*(F.coalesce(s, F.lit("null")) for s in slots)), ","), F.lit("]")))
    parts = []
    for key, below in node.items():
        text = _render(below)
        parts.append(F.when(text.isNotNull(), F.concat(F.lit(f'"{key}":'), text)))
    joined = F.array_compact(F.array(*parts))
    return F.when(F.size(joined) > 0, F.concat(F.lit("{"), F.array_join(joined, ","), F.lit("}")))


def project(profiles: DataFrame, config: ProjectionConfig, key: str = "candidate_key") -> DataFrame:
    """Returns key, output (JSON), errors (array of code, path, source)."""
    issues = config_issues(config)
    if issues:
        raise ValueError(f"invalid projection: {issues}")
    tree, errors, values = _Tree(), [], []

    def failure(code: str, f: ProjectionField) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(f.path).alias("path"), F.lit(f.source_path).alias("source"))

    for f in config.fields:
        try:
            got = resolve(f.source_path, profiles.schema)
        except PathError:
            errors.append(failure("PROJECTION_SOURCE_PATH_INVALID", f))
            continue
        if got.column is None:
            value, fits, present = F.lit(None).cast("string"), F.lit(False), F.lit(False)
        else:
            value, kind = _under_directives(got.column, got.type, f.normalize)
            values.append(value.alias(f"_v{len(values)}"))  # each value is computed once, below
            value = F.col(f"_v{len(values) - 1}")
            present = value.isNotNull() & (F.size(value) > 0 if got.many else F.lit(True))
            fits = F.lit(type_name(kind) == f.type)
            if isinstance(kind, T.ArrayType):
                fits = fits & F.forall(value, lambda x: x.isNotNull())
        usable = present & fits
        missing = F.lit("null") if config.on_missing == "null" else F.lit(None).cast("string")
        try:
            _assign(tree, f.path, _Leaf(F.when(usable, json_of(value)).otherwise(missing)))
        except PathError:
            errors.append(failure("PROJECTION_OUTPUT_PATH_INVALID", f))
            continue
        if f.required:
            errors.append(F.when(present & ~fits, failure("PROJECTION_TYPE_MISMATCH", f)).when(~present, failure("PROJECTION_REQUIRED_FIELD_MISSING", f)))
        elif config.on_missing == "error":
            errors.append(F.when(~usable, failure("PROJECTION_FIELD_MISSING", f)))
    if config.include_confidence:
        tree["overallConfidence"] = _Leaf(json_of(F.col("overallConfidence")["value"]))
    if config.include_provenance:
        tree["provenance"] = _Leaf(json_of(F.col("provenance")))
    none = F.array().cast("array<struct<code:string,path:string,source:string>>")
    found = F.array_compact(F.array(*errors)) if errors else none
    flags = ["overallConfidence"] * config.include_confidence + ["provenance"] * config.include_provenance
    rows = settled(profiles.select(key, *values, *(c for c in flags if c != key)))
    return rows.select(key, F.coalesce(_render(tree), F.lit("{}")).alias("output"), found.cast("array<struct<code:string,path:string,source:string>>").alias("errors"))
