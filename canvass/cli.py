"""Command line: init, validate, clean, report, export."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from .errors import CanvassError, ManifestError
from .operators.summary import build_report_data
from .plans.codebook import Severity
from .plans.rules import load_rules
from .plugins import REPORTS, plugin
from .run import Orchestrator, Stage, artifact_of, completed, read_log
from .sources.artifacts import load_findings

FOLDERS = ("metadata", "rules", "datasets/raw", "datasets/processed", "reports", "logs")
STARTER_CODEBOOK = """questions:
  - id: EXAMPLE_RESPONSE
    type: text
    label: "An example: free text"
"""
STARTER_RULES = """rules:
  - id: example_response_check
    type: range
    when: "EXAMPLE_RESPONSE == ''"
    severity: warning
    message: "The response is empty"
"""


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="canvass", description="Survey data quality on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init", help="make a project folder with starter files")
    init.add_argument("project_dir", type=Path)

    def runner(name: str, help_text: str, rules: bool) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help_text)
        p.add_argument("--data", type=Path, required=True)
        p.add_argument("--metadata", type=Path, required=True)
        if rules:
            p.add_argument("--rules", type=Path, required=True)
        p.add_argument("--run-dir", type=Path, required=True)
        p.add_argument("--parser", default="yaml")
        p.add_argument("--backend", default="spark")
        p.add_argument("--resume", action="store_true")
        return p

    runner("validate", "clean and validate; exit 1 if there are errors", True)
    runner("clean", "clean only; domains are checked too", False)
    export = runner("export", "clean, validate and write a report", True)
    export.add_argument("--report-output", type=Path, required=True)
    export.add_argument("--report-format", default="json")
    report = sub.add_parser("report", help="write a report of a stored run")
    report.add_argument("--run-dir", type=Path, required=True)
    report.add_argument("--format", default="json")
    report.add_argument("--output", type=Path, required=True)
    return top


def _init(folder: Path) -> None:
    for f in FOLDERS:
        (folder / f).mkdir(parents=True, exist_ok=True)
    for path, text in ((folder / "metadata/questionnaire.yaml", STARTER_CODEBOOK), (folder / "rules/rules.yaml", STARTER_RULES)):
        if not path.exists():
            path.write_text(text, encoding="utf-8")
        print(f"  {path}")
    print(f"Initialized project at {folder}")


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "report":
        log = read_log(args.run_dir / "manifest.json")
        if Stage.VALIDATING not in completed(log):
            raise ManifestError(f"the run in {args.run_dir} has not been validated yet")
        findings = load_findings(spark, artifact_of(log, Stage.VALIDATING))
        print(f"Report written to {plugin(REPORTS, args.format).build(build_report_data(findings), args.output)}")
        return 0
    rules = load_rules(args.rules) if args.command != "clean" else ()
    work = Orchestrator(spark, args.data, args.metadata, args.run_dir, rules=rules, parser=args.parser, backend=args.backend)
    data = build_report_data(work.run(resume=args.resume))
    print(f"Total findings: {data.total}")
    for s in Severity:
        if data.severities[s]:
            print(f"  {s.value}: {data.severities[s]}")
    if args.command == "validate":
        return int(data.severities[Severity.ERROR] > 0)
    print(f"Cleaned data written to {work.cleaned_path}")
    if args.command == "export":
        print(f"Report written to {plugin(REPORTS, args.report_format).build(data, args.report_output)}")
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "init":
            _init(args.project_dir)
            return 0
        return _run(spark or SparkSession.builder.appName("canvass").getOrCreate(), args)
    except CanvassError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
