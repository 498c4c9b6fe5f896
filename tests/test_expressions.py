"""The compiler against Python's own meaning, and what it refuses."""

import itertools

import pytest
from pyspark.sql import functions as F

from canvass.errors import RuleEvaluationError, RuleParseError, UnknownVariableError, UnsafeExpressionError
from canvass.functions.expressions import LENIENT, compile_expression, evaluated

NUMBERS = [-7, -3, -1, 0, 1, 2, 3, 10]


def values(spark, source, rows, schema, mode="strict", functions=None):
    df = spark.createDataFrame(rows, schema)
    expression = compile_expression(source, functions=functions)
    return evaluated(lambda: [r[0] for r in df.select(expression.column(df.schema, mode)).collect()])


@pytest.mark.parametrize("source", [
    "a + b * 2 - 1", "a < 2 or b > 99", "1 <= a <= 3", "a == b or a != b and b", "not a", "a and b", "a or b", "a or b or 5", "-a + +b",
    "a in [1, 2, 3]", "a not in (1, b)", "abs(a - b) < 5", "a == 1.0", "(a > 0) == True", "a == '1'", "a < b < 5 or a == 3", "a in []",
])
def test_agrees_with_python(spark, source):
    rows = list(itertools.product(NUMBERS, NUMBERS))
    expected = [eval(source, {"abs": abs}, {"a": a, "b": b}) for a, b in rows]  # noqa: S307 - the oracle
    assert values(spark, source, rows, "a long, b long") == expected


@pytest.mark.parametrize("source", ["a / b", "a % b", "(a * 1.5) % b", "a % (b * 0.5)"])
def test_division_agrees_with_python(spark, source):
    rows = [(a, b) for a, b in itertools.product(NUMBERS, NUMBERS) if b]
    expected = [eval(source, {}, {"a": a, "b": b}) for a, b in rows]  # noqa: S307
    assert values(spark, source, rows, "a long, b long") == pytest.approx(expected)


def test_text_and_missing_values(spark):
    rows = [("ab", None), ("", "b"), (None, None), ("b", "b")]
    schema = "s string, t string"
    assert values(spark, "s == t", rows, schema) == [False, False, True, True]
    assert values(spark, "s == None", rows, schema) == [False, False, True, False]
    assert values(spark, "s in ['ab', None]", rows, schema) == [True, False, True, False]
    assert values(spark, "not s", rows, schema) == [False, True, True, False]
    assert values(spark, "'b' in s", rows, schema, LENIENT) == [True, False, False, True]
    with pytest.raises(RuleEvaluationError):
        values(spark, "s < 'c'", rows, schema)


def test_selections(spark):
    rows = [([1, 2], [2, 1]), ([1], [1, 2]), ([], None), (None, None)]
    schema = "p array<long>, q array<long>"
    assert values(spark, "p == q", rows, schema) == [True, False, False, True]
    assert values(spark, "p <= q", rows[:2], schema) == [True, True]
    assert values(spark, "p < q", rows[:2], schema) == [False, True]
    assert values(spark, "2 in p", rows[:3], schema) == [True, False, False]
    assert values(spark, "p == [2, 1]", rows, schema) == [True, False, False, False]


def test_short_circuit_hides_errors(spark):
    rows = [(0, None), (1, 2)]
    assert values(spark, "a == 1 and 10 / b > 1", rows, "a long, b long") == [False, True]
    assert values(spark, "a == 0 or b > 1", rows, "a long, b long") == [True, True]


@pytest.mark.parametrize(("source", "row"), [("a + b", (1, None)), ("a / b", (1, 0)), ("a % b", (1, 0)), ("a < b", (1, None)), ("abs(b)", (1, None))])
def test_data_errors_are_raised_or_null(spark, source, row):
    with pytest.raises(RuleEvaluationError):
        values(spark, source, [row], "a long, b long")
    assert values(spark, source, [row], "a long, b long", LENIENT) in ([None], [False])


@pytest.mark.parametrize("source", ["a + s", "a + f", "a < s", "-s", "s in a", "a in a", "a < None"])
def test_type_errors_are_raised_when_built(spark, source):
    with pytest.raises(RuleEvaluationError):
        values(spark, source, [(1, "x", True)], "a long, s string, f boolean")


def test_unknown_names(spark):
    with pytest.raises(UnknownVariableError):
        values(spark, "zz == 1", [(1,)], "a long")


@pytest.mark.parametrize("source", [
    "a.b", "a[0]", "f(1)", "(lambda: 1)()", "[x for x in a]", "{1: 2}", "(a := 1)", "f'{a}'", "abs(*a)", "abs(x=1)", "a if b else c", "a | b", "a ** 2",
    "a // 2", "a @ b", "~a", "a >> 1", "a is None", "1j", "b'x'", "...", "__import__('os')", "{x for x in a}", "(yield)", "abs(1)(2)",
])
def test_unsafe_expressions(source):
    with pytest.raises(UnsafeExpressionError):
        compile_expression(source)


@pytest.mark.parametrize("source", ["", "a +", "a b", "1 +" * 90 + "1", "(" * 500 + "1" + ")" * 500])
def test_unparsable_expressions(source):
    with pytest.raises(RuleParseError):
        compile_expression(source)


def test_functions_and_names(spark):
    double = {"double": lambda c: c * 2}
    assert values(spark, "double(a) + abs(-1)", [(4,)], "a long", functions=double) == [9]
    assert compile_expression("abs(a) + b - a").names == ("a", "b")
    assert repr(compile_expression("a")) == "CompiledExpression('a')"
    assert compile_expression("A < 18 or 'x' in B").evaluate(spark, {"A": 20, "B": "axb"}) is True


def test_rules_stay_pushable(spark, tmp_path):
    spark.range(10).withColumn("v", F.col("id") * 1.5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for source, pushed in (("v in [1.5, 3.0]", "In(v, [1.5,3.0])"), ("v < 3.0", "LessThan(v,3.0)"), ("id == 2", "EqualNullSafe(id,2)")):
        plan = df.where(compile_expression(source).condition(df.schema, LENIENT))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and pushed in plan
