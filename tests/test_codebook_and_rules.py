import pytest

from canvass import errors as E
from canvass.plans import codebook_yaml
from canvass.plans.codebook import Category, Codebook, DerivedVariable, GridQuestion, MultiQuestion, NumericQuestion, RankingQuestion, SingleQuestion, TextQuestion
from canvass.plans.rules import parse_rules, load_rules

BOOK = """
questions:
  - {id: AGE, type: numeric, label: Age, min_value: 18, max_value: 99, required: true}
  - {id: SEX, type: single, label: Sex, categories: [{code: 1, label: F}, {code: 2, label: M}]}
  - {id: Q8, type: multi, label: Brands, max_selections: 2, categories: [{code: 1, label: A}, {code: 2, label: B}, {code: 3, label: C}]}
  - {id: WHY, type: text, label: Why, max_length: 10}
  - {id: RK, type: ranking, label: Rank, rank_count: 1, items: [{code: 1, label: A}, {code: 2, label: B}]}
  - id: G
    type: grid
    label: Grid
    columns: [{code: 1, label: bad}, {code: 2, label: good}]
    rows: [{id: G_1, label: Price}, {id: G_2, label: Taste, type: numeric, max_value: 5}, {id: G_3, label: Look, categories: [{code: 7, label: x}]}]
  - {id: OLDER, type: derived, label: Older, expression: AGE + 1, depends_on: [AGE]}
"""


def test_round_trip():
    book = codebook_yaml.loads(BOOK)
    assert [q.id for q in book] == ["AGE", "SEX", "Q8", "WHY", "RK", "G", "G_1", "G_2", "G_3", "OLDER"]
    again = codebook_yaml.loads(codebook_yaml.dumps(book))
    assert again.questions == book.questions
    rows = codebook_yaml.serialize_codebook(book)["questions"][5]["rows"]
    assert rows[0] == {"id": "G_1", "label": "Price"} and rows[2]["categories"] == [{"code": 7, "label": "x"}]
    assert {f.name: f.dataType.simpleString() for f in book.struct_type()}["Q8"] == "array<bigint>"


@pytest.mark.parametrize("text", [
    "[]", "questions: 3", "questions: []", "questions: [{id: A, type: nope, label: x}]", "questions: [{id: A, type: text}]", "questions: [{id: A, type: numeric, label: x, min_value: true}]",
    "questions: [{id: A, type: text, label: x, required: null}]", "questions: [{id: A, type: text, label: x, required: 'yes'}]", ": :",
    "questions: [{id: A, type: single, label: x, categories: [{code: 1, label: s}, {code: 2, label: s}]}]",
    "questions: [{id: A, type: grid, label: x, columns: [{code: 1, label: s}], rows: [{id: B, label: b, type: derived}]}]",
])
def test_bad_codebooks(text):
    with pytest.raises(E.MetadataParseError):
        codebook_yaml.loads(text)


def one(n=1):
    return tuple(Category(k, f"c{k}") for k in range(n))


@pytest.mark.parametrize("make", [
    lambda: Category(1, " "), lambda: TextQuestion("", "x"), lambda: TextQuestion("a", " "), lambda: SingleQuestion("a", "a"), lambda: SingleQuestion("a", "a", categories=one() + one()),
    lambda: MultiQuestion("a", "a", categories=one(2), max_selections=3), lambda: NumericQuestion("a", "a", min_value=2, max_value=1), lambda: TextQuestion("a", "a", max_length=0),
    lambda: RankingQuestion("a", "a", items=one(), rank_count=2), lambda: GridQuestion("a", "a", rows=(), columns=one()), lambda: DerivedVariable("a", "a", expression=" "),
    lambda: DerivedVariable("a", "a", expression="1", depends_on=("a",)), lambda: DerivedVariable("a", "a", expression="1", depends_on=("b", "b")),
    lambda: GridQuestion("a", "a", rows=(GridQuestion("b", "b", rows=(TextQuestion("c", "c"),), columns=one()),), columns=one()),
])
def test_bad_questions(make):
    with pytest.raises(E.InvalidQuestionDefinitionError):
        make()


def test_derivation_order_and_its_errors():
    d = lambda i, *on: DerivedVariable(i, i, expression="1", depends_on=on)
    assert [v.id for v in Codebook([d("d", "b", "c"), d("c", "a"), d("b", "a"), d("a")]).derived_variables] == ["a", "b", "c", "d"]
    with pytest.raises(E.CircularDependencyError):
        Codebook([d("a", "b"), d("b", "a")])
    with pytest.raises(E.UnknownVariableError):
        Codebook([d("a", "zz")])
    with pytest.raises(E.DuplicateQuestionIdError):
        Codebook([d("a"), d("a")])
    with pytest.raises(E.UnknownVariableError):
        Codebook([d("a")]).get_question("b")


RULES = """
rules:
  - {id: a, type: range, when: AGE < 18 or AGE > 99, severity: warning, message: old}
  - {id: b, type: required, variable: Q1, when: null}
  - {id: c, type: skip_logic, when: "Q1 == 'Yes'", then_required: [Q2], else_variables: [Q3]}
  - {id: d, type: sum_equals, variables: [X, Y], target: 100, tolerance: 0.5}
  - {id: e, type: max_selections, variable: Q8, max_selections: 2}
  - {id: f, type: exclusive_category, variable: Q8, exclusive_codes: [9]}
  - {id: g, type: rank, rank_variables: [R1, R2], min_ranked: 1, other_variable: O, other_text_variable: OT}
"""


def test_rules_are_read(tmp_path):
    rules = parse_rules(RULES)
    assert [type(r).__name__ for r in rules] == ["RangeRule", "RequiredRule", "SkipLogicRule", "SumEqualsRule", "MaxSelectionsRule", "ExclusiveCategoryRule", "RankRule"]
    assert rules[0].severity == "warning" and rules[1].when is None
    (tmp_path / "r.yaml").write_text("rules: [{id: a, type: zz}]")
    with pytest.raises(E.RuleParseError, match="In .*r.yaml"):
        load_rules(tmp_path / "r.yaml")
    with pytest.raises(E.RuleParseError):
        load_rules(tmp_path / "none.yaml")


@pytest.mark.parametrize(("rule", "error"), [
    ("{id: a, type: range}", E.RuleParseError), ("{id: a, type: range, when: '1 +'}", E.RuleParseError), ("{id: a, type: range, when: a.b}", E.UnsafeExpressionError),
    ("{id: a, type: required, variable: x, when: true}", E.RuleParseError), ("{id: a, type: range, when: '1', severity: bad}", E.RuleParseError),
    ("{id: ' ', type: range, when: '1'}", E.InvalidRuleDefinitionError), ("{id: a, type: sum_equals, variables: [x], target: 1}", E.InvalidRuleDefinitionError),
    ("{id: a, type: sum_equals, variables: [x, y], target: 1, tolerance: -1}", E.InvalidRuleDefinitionError), ("{id: a, type: sum_equals, variables: [x, y], target: true}", E.RuleParseError),
    ("{id: a, type: skip_logic, when: '1', then_required: []}", E.InvalidRuleDefinitionError), ("{id: a, type: max_selections, variable: x, max_selections: 0}", E.InvalidRuleDefinitionError),
    ("{id: a, type: exclusive_category, variable: x, exclusive_codes: []}", E.InvalidRuleDefinitionError), ("{id: a, type: rank, rank_variables: [x], min_ranked: 2}", E.InvalidRuleDefinitionError),
    ("{id: a, type: rank, rank_variables: [x], other_variable: y}", E.InvalidRuleDefinitionError), ("{id: a, type: rank, rank_variables: [x, x]}", E.InvalidRuleDefinitionError),
])
def test_bad_rules(rule, error):
    with pytest.raises(error):
        parse_rules(f"rules: [{rule}]")


def test_rule_ids_are_unique():
    with pytest.raises(E.RuleParseError):
        parse_rules("rules: [{id: a, type: range, when: '1'}, {id: a, type: range, when: '1'}]")
