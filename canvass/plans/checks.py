"""Checks: codebook domains and rules as boolean columns with messages, for one schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RuleEvaluationError, UnknownColumnError, UnknownVariableError
from ..functions.expressions import STRICT, quoted
from .codebook import Codebook, DerivedVariable, GridQuestion, MultiQuestion, NumericQuestion, Question, RankingQuestion, Severity, SingleQuestion, TextQuestion
from .rules import ExclusiveCategoryRule, MaxSelectionsRule, RangeRule, RankRule, RequiredRule, Rule, SkipLogicRule, SumEqualsRule


@dataclass(frozen=True)
class Check:
    """A finding for each row where ``violated`` (never null) holds."""

    rule_id: str
    severity: Severity
    violated: Column
    message: Column
    variables: tuple[str, ...]
    check_ord: int = 0
    var_ord: int = 0


def _true(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def _shown(name: str, data_type: T.DataType) -> Column:
    """A cell as Python would print it."""
    col = quoted(name)
    if isinstance(data_type, T.StringType):
        return F.concat(F.lit("'"), F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    if isinstance(data_type, T.BooleanType):
        return F.when(col, "True").otherwise("False")
    return col.cast("string")


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def _is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _plain(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


class _Domain:
    def __init__(self, q: Question, data_type: T.DataType) -> None:
        self.q, self.type, self.col = q, data_type, quoted(q.id)
        self.found: list[tuple[str, Column, Column]] = []

    def add(self, name: str, violated: Column, *message: str | Column) -> None:
        self.found.append((name, _true(violated), _said(*message)))

    def checks(self) -> list[tuple[str, Column, Column]]:
        q, shown = self.q, _shown(self.q.id, self.type)
        if q.required:
            self.add("required", self.col.isNull(), f"{q.id} is required.")
        present = self.col.isNotNull()
        if isinstance(self.type, T.NullType):
            return self.found
        match q:
            case SingleQuestion():
                codes = [c.code for c in q.categories]
                bad = present
                if _is_number(self.type):
                    number = self.col.cast("double") if not isinstance(self.type, T.IntegralType) else self.col
                    bad = present & ~number.isin(*codes)
                self.add("category", bad, f"{q.id} value ", shown, " is not a valid category code.")
            case MultiQuestion():
                if not isinstance(self.type, T.ArrayType):
                    self.add("type", present, f"{q.id} value ", shown, " is not a selection of category codes.")
                    return self.found
                known = F.array(*[F.lit(c.code).cast(self.type.elementType) for c in q.categories])
                # A code by code test keeps nulls inside a selection as invalid codes.
                invalid = F.array_except(self.col, known) if _is_number(self.type.elementType) else self.col
                listed = F.array_sort(F.transform(invalid, lambda x: F.coalesce(x.cast("string"), F.lit("None"))))
                self.add("category", F.size(invalid) > 0, f"{q.id} contains invalid category codes: [", F.concat_ws(", ", listed), "].")
                if q.max_selections is not None:
                    n = F.size(F.array_distinct(self.col))
                    self.add("max_selections", n > q.max_selections, f"{q.id} has ", n, f" selections, exceeding the declared maximum of {q.max_selections}.")
            case NumericQuestion():
                if not _is_number(self.type):
                    self.add("type", present, f"{q.id} value ", shown, " is not numeric.")
                    return self.found
                if q.min_value is not None:
                    self.add("range", self.col < q.min_value, f"{q.id} value ", shown, f" is below the minimum of {q.min_value}.")
                if q.max_value is not None:
                    self.add("range", self.col > q.max_value, f"{q.id} value ", shown, f" is above the maximum of {q.max_value}.")
            case TextQuestion():
                if not isinstance(self.type, T.StringType):
                    self.add("type", present, f"{q.id} value ", shown, " is not text.")
                elif q.max_length is not None:
                    n = F.length(self.col)
                    self.add("max_length", n > q.max_length, f"{q.id} text is ", n, f" characters, exceeding the maximum of {q.max_length}.")
        return self.found


def domain_checks(codebook: Codebook, schema: T.StructType) -> list[Check]:
    """In codebook order; questions without a column, and those without a domain, are passed over."""
    types, out = {f.name: f.dataType for f in schema.fields}, []
    for q in codebook:
        if isinstance(q, DerivedVariable | GridQuestion | RankingQuestion) or q.id not in types:
            continue
        out += [Check(f"__domain__:{q.id}:{name}", Severity.ERROR, violated, message, (q.id,)) for name, violated, message in _Domain(q, types[q.id]).checks()]
    return out


class _Rules:
    def __init__(self, schema: T.StructType, mode: str) -> None:
        self.schema, self.mode = schema, mode
        self.types = {f.name: f.dataType for f in schema.fields}

    def variable(self, rule: Rule, name: str) -> Column:
        if name not in self.types:
            raise UnknownVariableError(f"rule {rule.id!r} uses unknown variable {name!r}")
        return quoted(name)

    def column(self, rule: Rule, name: str) -> Column:
        if name not in self.types:
            raise UnknownColumnError(f"rule {rule.id!r}: no column {name!r}; there are {sorted(self.types)}")
        return quoted(name)

    def selection(self, rule: Rule, name: str) -> Column:
        col = self.column(rule, name)
        if isinstance(self.types[name], T.NullType):
            return col.cast("array<bigint>")
        if not isinstance(self.types[name], T.ArrayType):
            raise RuleEvaluationError(f"rule {rule.id!r}: {name} is not a selection of codes")
        return col

    def parts(self, rule: Rule) -> list[tuple[Column, Column, tuple[str, ...]]]:
        """(violated, default message, variables) for each kind of finding of a rule."""
        match rule:
            case RangeRule():
                return [(rule.when.condition(self.schema, self.mode), F.lit(f"Rule {rule.id!r} violated: {rule.when.source}"), ())]
            case RequiredRule():
                missing = self.variable(rule, rule.variable).isNull()
                if rule.when is not None:
                    missing = F.when(rule.when.condition(self.schema, self.mode), missing).otherwise(F.lit(False))
                return [(missing, F.lit(f"{rule.variable} is required."), (rule.variable,))]
            case SkipLogicRule():
                gate, source = rule.when.condition(self.schema, self.mode), rule.when.source
                out = [(gate & self.variable(rule, v).isNull(), F.lit(f"{v} is required when {source}."), (v,)) for v in rule.then_required]
                return out + [(~gate & self.variable(rule, v).isNotNull(), F.lit(f"{v} should be blank when not ({source})."), (v,)) for v in rule.else_variables]
            case SumEqualsRule():
                cols = [self.column(rule, v) for v in rule.variables]
                for v in rule.variables:
                    if not (_is_number(self.types[v]) or isinstance(self.types[v], T.NullType)):
                        raise RuleEvaluationError(f"rule {rule.id!r}: {v} is not numeric")
                wide = [c.cast("bigint") if isinstance(self.types[v], T.IntegralType) else c.cast("double") for c, v in zip(cols, rule.variables, strict=True)]
                total = reduce(lambda x, y: x + y, wide)
                names = "(" + ", ".join(repr(v) for v in rule.variables) + ")"
                return [(_true(F.abs(total - rule.target) > rule.tolerance), _said(f"Sum of {names} should equal {rule.target} (got ", total, ")."), rule.variables)]
            case MaxSelectionsRule():
                n = F.size(F.array_distinct(self.selection(rule, rule.variable)))
                message = _said(f"{rule.variable} has ", n, f" selections, exceeding the maximum of {rule.max_selections}.")
                return [(_true(n > rule.max_selections), message, (rule.variable,))]
            case ExclusiveCategoryRule():
                chosen = self.selection(rule, rule.variable).cast("array<bigint>")
                alone = F.array(*[F.lit(c).cast("bigint") for c in rule.exclusive_codes])
                mixed = (F.size(F.array_intersect(chosen, alone)) > 0) & (F.size(F.array_except(chosen, alone)) > 0)
                return [(_true(mixed), F.lit(f"{rule.variable} combines an exclusive category with other selections."), (rule.variable,))]
            case RankRule():
                return self.rank(rule)
        raise RuleEvaluationError(f"rule {rule.id!r} is of no known type")

    def rank(self, rule: RankRule) -> list[tuple[Column, Column, tuple[str, ...]]]:
        """An extension: number of filled slots, bounds of each, and a text behind "other"."""
        cols = {v: self.variable(rule, v) for v in rule.rank_variables}
        filled = reduce(lambda x, y: x + y, [F.when(c.isNotNull(), 1).otherwise(0) for c in cols.values()])
        top = len(cols) if rule.max_ranked is None else rule.max_ranked
        out = [(~filled.between(rule.min_ranked, top), _said("", filled, f" ranks given; {rule.min_ranked} to {top} are allowed."), rule.rank_variables)]
        for v, c in cols.items():
            low = c < rule.min_rank_value if rule.min_rank_value is not None else F.lit(False)
            high = c > rule.max_rank_value if rule.max_rank_value is not None else F.lit(False)
            out.append((_true(low | high), F.lit(f"{v} is outside the allowed ranks."), (v,)))
        if rule.other_variable is not None:
            flag, text = self.truthy(rule, rule.other_variable), self.variable(rule, rule.other_text_variable)
            blank = F.coalesce(F.length(F.regexp_replace(text.cast("string"), r"(?U)\s", "")) == 0, F.lit(True))
            out.append((flag & blank, F.lit(f"{rule.other_text_variable} is required with {rule.other_variable}."), (rule.other_text_variable,)))
        if rule.exclusive_flag_variable is not None:
            applies = ~self.truthy(rule, rule.exclusive_flag_variable)
            out = [(applies & violated, message, names) for violated, message, names in out]
        return out

    def truthy(self, rule: Rule, name: str) -> Column:
        from ..functions.expressions import compile_expression

        self.variable(rule, name)
        return compile_expression(f"not not {name}").condition(self.schema, self.mode)


def rule_checks(rules: Iterable[Rule], schema: T.StructType, mode: str = STRICT) -> list[Check]:
    maker, out = _Rules(schema, mode), []
    for rule in rules:
        for n, (violated, message, variables) in enumerate(maker.parts(rule)):
            out.append(Check(rule.id, rule.severity, violated, F.lit(rule.message) if rule.message else message, variables, var_ord=n))
    return out


def all_checks(codebook: Codebook | None, rules: Sequence[Rule], schema: T.StructType, mode: str = STRICT) -> list[Check]:
    """Domain checks in codebook order, then rules in file order, numbered in that order."""
    out: list[Check] = []
    order, previous = -1, None
    for c in [*(domain_checks(codebook, schema) if codebook is not None else []), *rule_checks(rules, schema, mode)]:
        group = c.variables if c.rule_id.startswith("__domain__:") else c.rule_id
        if group != previous:
            order, previous, n = order + 1, group, 0
        out.append(Check(c.rule_id, c.severity, c.violated, c.message, c.variables, order, n))
        n += 1
    return out
