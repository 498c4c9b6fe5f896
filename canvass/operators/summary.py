"""Summaries of findings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import InconsistentRuleSeverityError
from ..plans.codebook import Severity
from .validate import ORDER


def by_rule(findings: DataFrame) -> DataFrame:
    """(rule_id, severity, n), sorted by rule."""
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("n")).orderBy("rule_id", "severity")


def by_severity(findings: DataFrame) -> DataFrame:
    """(severity, n) for every severity, zero where there are no findings."""
    spark: SparkSession = findings.sparkSession
    levels = spark.createDataFrame([(k, s.value) for k, s in enumerate(Severity)], "k int, severity string")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    joined = levels.join(counts, "severity", "left")
    return joined.orderBy("k").select("severity", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@dataclass(frozen=True)
class RuleSummary:
    rule_id: str
    severity: Severity
    count: int


@dataclass(frozen=True)
class ReportData:
    """Counts on the driver (a row for each rule); the findings stay a table."""

    generated_at: datetime
    findings: DataFrame
    rules: tuple[RuleSummary, ...]
    severities: dict[Severity, int]

    @property
    def total(self) -> int:
        return sum(self.severities.values())

    def rows(self) -> Iterator[Row]:
        """Findings in order, streamed partition by partition."""
        return self.findings.orderBy(*[c for c in ORDER if c in self.findings.columns]).toLocalIterator()


def build_report_data(findings: DataFrame) -> ReportData:
    """One aggregation by rule; severities and the total follow from it."""
    rows = by_rule(findings).collect()
    seen: dict[str, str] = {}
    for r in rows:
        if seen.setdefault(r.rule_id, r.severity) != r.severity:
            raise InconsistentRuleSeverityError(f"rule {r.rule_id!r} has findings of severity {seen[r.rule_id]} and {r.severity}")
    severities = {s: sum(r.n for r in rows if r.severity == s.value) for s in Severity}
    return ReportData(datetime.now(UTC), findings, tuple(RuleSummary(r.rule_id, Severity(r.severity), r.n) for r in rows), severities)
