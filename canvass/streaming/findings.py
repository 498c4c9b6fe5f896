"""Validation of streams: the same checks, row by row, without state (an extension)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import LENIENT
from ..operators.validate import validate
from ..plans.codebook import Codebook
from ..plans.rules import Rule


def stream_findings(stream: DataFrame, codebook: Codebook | None, rules: Sequence[Rule], *, key: str, keep: Sequence[str] = (), mode: str = LENIENT) -> DataFrame:
    """A stream of findings; ``key`` must name a column, as rows of a stream have no place. Lenient,
    so that one bad row doesn't end the query."""
    return validate(stream, codebook, rules, key=key, keep=keep, mode=mode)


def windowed_counts(findings: DataFrame, time_col: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by rule and time window; ``time_col`` must be among the kept columns."""
    counted = findings.withWatermark(time_col, late).groupBy(F.window(time_col, window), "rule_id", "severity").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "rule_id", "severity", "n")
