import pytest
from pyspark.sql import functions as F

from canvass import errors as E
from canvass.functions.expressions import evaluated
from canvass.operators.clean import coerce_to_codebook, complete_grids, default_steps, derive, expand_multi, recode, run_pipeline
from canvass.operators.summary import build_report_data, by_severity
from canvass.operators.validate import Findings, validate, with_row_index
from canvass.plans import codebook_yaml
from canvass.plans.codebook import Codebook, DerivedVariable, MultiQuestion, NumericQuestion, SingleQuestion, TextQuestion
from canvass.plans.rules import parse_rules

from test_codebook_and_rules import BOOK, one

ACCEPTANCE = "AGE long, Q1 string, Q2 string, S9_1 long, S9_2 long, Q8 array<long>, _row_index long"
PEOPLE = [(15, "Yes", None, 40, 60, [1, 2], 0), (30, "No", None, 40, 50, [1, 2, 3], 1), (45, "Yes", "ok", 50, 50, [1], 2), (150, "No", "x", 50, 50, [2], 3)]
RULES = """
rules:
  - {id: age_range, type: range, when: AGE < 18 or AGE > 99}
  - {id: q2_gate, type: skip_logic, when: "Q1 == 'Yes'", then_required: [Q2], else_variables: [Q2]}
  - {id: sum100, type: sum_equals, variables: [S9_1, S9_2], target: 100}
  - {id: max2, type: max_selections, variable: Q8, max_selections: 2}
"""


def test_acceptance(spark):
    df = spark.createDataFrame(PEOPLE, ACCEPTANCE)
    found = Findings(validate(df, None, parse_rules(RULES)))
    rows = [(r.rule_id, r.row_index) for r in found]
    assert rows == [("age_range", 0), ("age_range", 3), ("q2_gate", 0), ("q2_gate", 3), ("sum100", 1), ("max2", 1)]
    said = {r.rule_id: r.message for r in found.frame.collect()}
    assert said["sum100"] == "Sum of ('S9_1', 'S9_2') should equal 100.0 (got 90)."
    assert said["max2"] == "Q8 has 3 selections, exceeding the maximum of 2."
    assert {r.message for r in found.by_rule("q2_gate")} == {"Q2 is required when Q1 == 'Yes'.", "Q2 should be blank when not (Q1 == 'Yes')."}
    assert len(found) == 6 and found.has_errors() and not found.by_severity("info").has_errors() and len(found.extend(found)) == 12
    plan = found.frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Python" not in plan


def test_domains(spark):
    book = codebook_yaml.loads(BOOK)
    df = spark.createDataFrame([(17.0, 1, [1, 9], "short", 0), (None, 3, [1, 2, 3], "x" * 11, 1), (50.0, None, None, None, 2)], "AGE double, SEX long, Q8 array<long>, WHY string, _row_index long")
    rows = [(r.rule_id, r.row_index) for r in Findings(validate(df, book))]
    d = "__domain__:"
    assert rows == [(d + "AGE:range", 0), (d + "AGE:required", 1), (d + "SEX:category", 1), (d + "Q8:category", 0), (d + "Q8:max_selections", 1), (d + "WHY:max_length", 1)]
    text = spark.createDataFrame([("15", "1", 0), (None, None, 1)], "AGE string, Q8 string, _row_index long")
    assert [(r.rule_id, r.message) for r in Findings(validate(text, book)).by_rule(d + "AGE:type")] == [(d + "AGE:type", "AGE value '15' is not numeric.")]


def test_missing_columns_and_wrong_types(spark):
    df = spark.createDataFrame([(1, "x", 0)], "a long, s string, _row_index long")
    for rule, error in (
        ("{id: r, type: required, variable: zz}", E.UnknownVariableError), ("{id: r, type: range, when: zz == 1}", E.UnknownVariableError),
        ("{id: r, type: sum_equals, variables: [a, zz], target: 1}", E.UnknownColumnError), ("{id: r, type: max_selections, variable: zz, max_selections: 1}", E.UnknownColumnError),
        ("{id: r, type: max_selections, variable: a, max_selections: 1}", E.RuleEvaluationError), ("{id: r, type: sum_equals, variables: [a, s], target: 1}", E.RuleEvaluationError),
    ):
        with pytest.raises(error):
            validate(df, None, parse_rules(f"rules: [{rule}]"))
    assert validate(df, None, []).count() == 0


def test_rank_extension(spark):
    rules = parse_rules("rules: [{id: r, type: rank, rank_variables: [A, B], max_rank_value: 3, exclusive_flag_variable: NONE, other_variable: O, other_text_variable: T}]")
    df = spark.createDataFrame([(None, None, 0, 0, None, 0), (None, None, 1, 0, None, 1), (1, 9, 0, 1, " ", 2), (1, 2, 0, 1, "t", 3)], "A int, B int, NONE int, O int, T string, _row_index long")
    assert [(r.row_index, tuple(r.variables)) for r in Findings(validate(df, None, rules))] == [(0, ("A", "B")), (2, ("B",)), (2, ("T",))]


def test_row_index_over_partitions(spark):
    df = with_row_index(spark.range(0, 100, 1, 7).where("id % 3 = 0"))
    assert [(r.id, r._row_index) for r in df.orderBy("id").collect()] == [(3 * k, k) for k in range(34)]
    assert with_row_index(spark.range(0)).count() == 0


def test_single_check_is_a_pushed_filter(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    found = validate(spark.read.parquet(str(tmp_path / "t")), None, parse_rules("rules: [{id: r, type: required, variable: id}]"), key="id")
    assert "PushedFilters: [IsNull(id)]" in found._jdf.queryExecution().executedPlan().toString()


MULTI = Codebook([MultiQuestion("Q", "Q", categories=one(4)[1:])])


def test_delimited_selections(spark):
    df = spark.createDataFrame([("3, 1,1",), (" ",), (None,), (",",), ("2",)], "Q string")
    assert [r.Q for r in expand_multi()(df, MULTI).collect()] == [[1, 3], None, None, [], [2]]
    piped = spark.createDataFrame([("1|3",)], "Q string")
    assert expand_multi("|")(piped, MULTI).first().Q == [1, 3]
    bad = expand_multi()(spark.createDataFrame([("1,x",)], "Q string"), MULTI)
    with pytest.raises(E.TransformationError):
        evaluated(bad.collect)
    with pytest.raises(E.TransformationError):
        expand_multi()(spark.createDataFrame([(1,)], "Q long"), MULTI)


def test_indicator_selections(spark):
    df = spark.createDataFrame([("x", "1", "0", ""), ("y", None, "", None), ("z", "0", "0", None)], "k string, Q_1 string, Q_2 string, Q_3 string")
    out = expand_multi()(df, MULTI)
    assert out.columns == ["k", "Q"] and [r.Q for r in out.collect()] == [[1], None, []]
    flags = spark.createDataFrame([(True, False, True)], "Q_1 boolean, Q_2 boolean, Q_3 boolean")
    assert expand_multi()(flags, MULTI).first().Q == [1, 3]
    assert expand_multi()(df.drop("Q_3"), MULTI).columns == ["k", "Q_1", "Q_2"]
    with pytest.raises(E.TransformationError):
        evaluated(expand_multi()(spark.createDataFrame([(2, 0, 0)], "Q_1 int, Q_2 int, Q_3 int"), MULTI).collect)
    done = spark.createDataFrame([([2],)], "Q array<long>")
    assert expand_multi()(done, MULTI) is done


def test_recode(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v long")
    assert [r.v for r in recode("v", {1: 2, 2: 1})(df, MULTI).collect()] == [2, 1, None]
    assert [r.v for r in recode("v", {1: 9}, default=0)(df, MULTI).collect()] == [9, 0, None]
    with pytest.raises(E.UnknownVariableError):
        recode("w", {})(df, MULTI)
    with pytest.raises(E.TransformationError):
        recode("v", {})(spark.createDataFrame([("a",)], "v string"), MULTI)
    with pytest.raises(E.TransformationError):
        evaluated(recode("v", {})(spark.createDataFrame([(1.5,)], "v double"), MULTI).collect)


def test_derived_chain_grid_and_pipeline(spark):
    book = codebook_yaml.loads(BOOK)
    df = spark.createDataFrame([(10,), (20,)], "AGE long")
    out = run_pipeline(df, book, default_steps())
    assert out.columns == ["AGE", "G_1", "G_2", "G_3", "OLDER"] and [r.OLDER for r in out.collect()] == [11, 21]
    assert dict(out.dtypes)["G_2"] == "double" and complete_grids(out, book) is out
    chain = Codebook([DerivedVariable("c", "c", expression="a + b", depends_on=("a", "b")), DerivedVariable("b", "b", expression="a * 2", depends_on=("a",)), DerivedVariable("a", "a", expression="AGE + 1")])
    assert [(r.a, r.b, r.c) for r in derive()(df, chain).collect()] == [(11, 22, 33), (21, 42, 63)]
    with pytest.raises(E.TransformationError):
        derive()(df, Codebook([DerivedVariable("a", "a", expression="nope + 1")]))


def test_coercion_extension(spark):
    book = Codebook([NumericQuestion("n", "n"), SingleQuestion("s", "s", categories=one()), TextQuestion("t", "t")])
    assert coerce_to_codebook(spark.createDataFrame([("1.5", "x", "1")], "n string, s string, t string"), book).first().asDict() == {"n": 1.5, "s": None, "t": "1"}


def test_summaries(spark):
    df = spark.createDataFrame(PEOPLE, ACCEPTANCE)
    found = validate(df, None, parse_rules(RULES))
    data = build_report_data(found)
    assert data.total == 6 and [(r.rule_id, r.count) for r in data.rules] == [("age_range", 2), ("max2", 1), ("q2_gate", 2), ("sum100", 1)]
    assert [(r.severity, r.n) for r in by_severity(found).collect()] == [("info", 0), ("warning", 0), ("error", 6)]
    with pytest.raises(E.InconsistentRuleSeverityError):
        build_report_data(found.unionByName(found.withColumn("severity", F.lit("info"))))
