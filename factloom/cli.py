"""Command line: ``python -m factloom.cli transform --ats FILE --resume FILE --config FILE [--output FILE] [--pdf-parser MODULE:FUNCTION]``.

A resume may be text, or a PDF if a parser is named: a function from bytes to text.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.project import config_issues, read_config
from .plans import pipeline
from .sources import records

REQUIRED = {"ats": "CLI_OPTION_ATS_MISSING", "resume": "CLI_OPTION_RESUME_MISSING", "config": "CLI_OPTION_CONFIG_MISSING"}


def main(argv: list[str] | None = None) -> int:
    """0 if an output was made, else 1; warnings and errors go to stderr."""
    parser = argparse.ArgumentParser(prog="factloom")
    transform = parser.add_subparsers(dest="command").add_parser("transform", help="fuse one candidate's sources into a projected profile")
    for name in (*REQUIRED, "output", "pdf-parser"):
        transform.add_argument(f"--{name}", default="")
    args = parser.parse_args(argv)
    if args.command != "transform":
        parser.print_help()
        return 1
    for name, code in REQUIRED.items():
        if not getattr(args, name).strip():
            print(f"error: {code} --{name} is required.", file=sys.stderr)
            return 1
    try:
        with open(args.config.strip(), encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError) as e:
        print(f"error: PIPELINE_RUNTIME_CONFIG_LOAD_FAILED {e}", file=sys.stderr)
        return 1
    config = read_config(raw)
    if issues := config_issues(config):
        print(f"error: PIPELINE_CONFIG_INVALID {issues}", file=sys.stderr)
        return 1
    try:
        return _transform(args, config)
    except Exception as e:  # whatever a stage or the cluster raises becomes one line and a status
        print(f"error: CLI_TRANSFORM_FAILED {type(e).__name__}: {e}", file=sys.stderr)
        return 1


def _transform(args: argparse.Namespace, config) -> int:
    spark = SparkSession.builder.getOrCreate()
    now, key = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z"), F.lit("candidate")
    resume = args.resume.strip()
    if args.pdf_parser.strip():
        module, _, function = args.pdf_parser.strip().partition(":")
        resumes = records.read_pdf_resumes(spark, resume, now, getattr(importlib.import_module(module), function), key)
    else:
        resumes = records.read_resumes(spark, resume, now, key)
    run = pipeline.run(records.read_structured(spark, args.ats.strip(), now, key).unionByName(resumes), config)
    errors = run.errors.collect()  # of one candidate
    for e in errors:
        print(f"error: {e.code} {e.message}", file=sys.stderr)
    rows = run.outputs.collect()  # one candidate
    if not rows:
        return 1
    if errors:
        print("warning: the output lacks the sources named above", file=sys.stderr)
    text = json.dumps(json.loads(rows[0].output), indent=2, ensure_ascii=False)
    if args.output.strip():
        with open(args.output.strip(), "w", encoding="utf-8") as f:
            f.write(text + "\n")
        print(f"written: {args.output.strip()}", file=sys.stderr)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
