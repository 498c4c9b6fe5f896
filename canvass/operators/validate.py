"""Validation: all checks in one scan, as a table of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownColumnError
from ..functions.expressions import STRICT, quoted
from ..plans.checks import Check, all_checks
from ..plans.codebook import Codebook, Severity
from ..plans.rules import Rule

ROW_INDEX = "_row_index"
ORDER = ("check_ord", "row_index", "var_ord")


def with_row_index(df: DataFrame, name: str = ROW_INDEX) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of its partitions.

    Two passes over the input: the first counts the rows of each partition (a row each on the
    driver), the second adds the rows before it. Nothing is shuffled or sorted.
    """
    counts = {r.p: r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(p, 0)
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    place = F.monotonically_increasing_id()
    return df.withColumn(name, F.get(F.lit(offsets).cast("array<bigint>"), F.shiftright(place, 33).cast("int")) + place.bitwiseAND(F.lit((1 << 33) - 1)))


def _finding(c: Check) -> Column:
    variables = F.array(*[F.lit(v) for v in c.variables]) if c.variables else F.array().cast("array<string>")
    return F.struct(
        F.lit(c.rule_id).alias("rule_id"), F.lit(c.severity.value).alias("severity"), c.message.alias("message"),
        variables.alias("variables"), F.lit(c.check_ord).alias("check_ord"), F.lit(c.var_ord).alias("var_ord"),
    )


def findings_of(df: DataFrame, checks: Sequence[Check], key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Findings of ``checks``: one scan whatever their number; a single check stays a pushable filter."""
    if key not in df.columns:
        raise UnknownColumnError(f"no column {key!r}; there are {df.columns}")
    kept = [quoted(c) for c in keep]
    if len(checks) == 1:
        rows = df.where(checks[0].violated).select(quoted(key).cast("bigint").alias("row_index"), *kept, _finding(checks[0]).alias("f"))
    else:
        nothing = F.array().cast("array<struct<rule_id:string,severity:string,message:string,variables:array<string>,check_ord:int,var_ord:int>>")
        found = F.array(*[F.when(c.violated, _finding(c)) for c in checks]) if checks else nothing
        rows = df.select(quoted(key).cast("bigint").alias("row_index"), *kept, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    return rows.select("f.rule_id", "f.severity", "f.message", "row_index", "f.variables", "f.check_ord", "f.var_ord", *kept)


def validate(df: DataFrame, codebook: Codebook | None, rules: Sequence[Rule] = (), *, key: str | None = None, keep: Sequence[str] = (), mode: str = STRICT) -> DataFrame:
    """(rule_id, severity, message, row_index, variables, check_ord, var_ord, *keep), lazily.

    ``key`` names a unique whole-number column that identifies rows; without it, the place of the
    row is used. ``keep`` are columns to carry along.
    """
    if key is None:
        key = ROW_INDEX
        if key not in df.columns:
            df = with_row_index(df)
    checks = all_checks(codebook, rules, df.drop(ROW_INDEX).schema, mode)
    return findings_of(df, checks, key, keep)


class Findings:
    """Questions asked of a findings table."""

    def __init__(self, frame: DataFrame) -> None:
        self.frame = frame

    def extend(self, other: Findings | DataFrame) -> Findings:
        more = other.frame if isinstance(other, Findings) else other
        return Findings(self.frame.unionByName(more))

    def ordered(self) -> DataFrame:
        """In the order of checks, rows and variables."""
        return self.frame.orderBy(*ORDER)

    def by_severity(self, severity: Severity | str) -> Findings:
        return Findings(self.frame.where(F.col("severity") == Severity(severity).value))

    def by_rule(self, rule_id: str) -> Findings:
        return Findings(self.frame.where(F.col("rule_id") == rule_id))

    def has_errors(self) -> bool:
        return not self.by_severity(Severity.ERROR).frame.isEmpty()

    def __len__(self) -> int:
        return self.frame.count()

    def __iter__(self):
        return self.ordered().toLocalIterator()
