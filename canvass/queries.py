"""The engine's queries over the driver's tables: codebooks and rules, compiled; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import compile_expression, with_derived
from .operators import shadow, summary
from .operators.clean import complete_grids, derive, expand_multi, recode, run_pipeline
from .operators.validate import Findings, validate
from .plans.codebook import Category, Codebook, DerivedVariable, GridQuestion, MultiQuestion, NumericQuestion, SingleQuestion, TextQuestion
from .plans.rules import parse_rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, rules: str, key: str) -> DataFrame:
    """Keys of the rows that violate."""
    return validate(df, None, parse_rules(rules), key=key).select(F.col("row_index").alias(key))


def _codes(*codes: int) -> tuple[Category, ...]:
    return tuple(Category(c, f"code {c}") for c in codes)


def _selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a made-up multi-response answer of up to three codes."""
    orders = _table(spark, sf_dir, "orders")
    sel = F.array_sort(F.array_distinct(F.array(F.col("o_orderkey") % 5, F.col("o_custkey") % 5, F.expr("o_orderkey div 5") % 5)))
    return orders.select("o_orderkey", sel.alias("sel"))


_SELECTIONS = "SELECT o_orderkey, list_distinct([o_orderkey % 5, o_custkey % 5, (o_orderkey // 5) % 5]) AS sel FROM orders"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(_table(spark, sf_dir, "labels"), "doc_id", "left")


# rules ----------------------------------------------------------------------


@_query("SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9900")
def rule_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_table(spark, sf_dir, "customer"), "rules: [{id: bal_range, type: range, when: 'c_acctbal < 0 or c_acctbal > 9900'}]", "c_custkey")


@_query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def rule_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_labelled(spark, sf_dir), "rules: [{id: q, type: required, variable: quality}]", "doc_id")


@_query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND l.quality IS NULL")
def rule_required_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_labelled(spark, sf_dir), "rules: [{id: q, type: required, variable: quality, when: \"lang == 'en'\"}]", "doc_id")


@_query("""
    SELECT d.doc_id, CASE WHEN d.lang = 'en' THEN 'quality' ELSE 'toxic' END AS variable FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE (d.lang = 'en' AND l.quality IS NULL) OR (d.lang <> 'en' AND l.toxic IS NOT NULL)
""")
def rule_skip_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = "rules: [{id: s, type: skip_logic, when: \"lang == 'en'\", then_required: [quality], else_variables: [toxic]}]"
    found = validate(_labelled(spark, sf_dir), None, parse_rules(rules), key="doc_id")
    return found.select(F.col("row_index").alias("doc_id"), F.explode("variables").alias("variable"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs((l_linenumber + CAST(l_quantity AS BIGINT)) - 30) > 20")
def rule_sum_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = parse_rules("rules: [{id: s, type: sum_equals, variables: [l_linenumber, quantity], target: 30, tolerance: 20}]")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("quantity"))
    return validate(lines, None, rules, key="l_orderkey", keep=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@_query(f"SELECT o_orderkey FROM ({_SELECTIONS}) WHERE len(sel) > 2")
def rule_max_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_selections(spark, sf_dir), "rules: [{id: m, type: max_selections, variable: sel, max_selections: 2}]", "o_orderkey")


@_query(f"SELECT o_orderkey FROM ({_SELECTIONS}) WHERE list_contains(sel, 4) AND len(sel) > 1")
def rule_exclusive_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_selections(spark, sf_dir), "rules: [{id: e, type: exclusive_category, variable: sel, exclusive_codes: [4]}]", "o_orderkey")


@_query("""
    SELECT p_partkey, 'slots' AS part FROM part WHERE p_size % 3 = 0 AND p_size % 2 = 0
    UNION ALL SELECT p_partkey, 'first' FROM part WHERE p_size % 3 <> 0 AND p_size % 7 > 4
    UNION ALL SELECT p_partkey, 'second' FROM part WHERE p_size % 2 <> 0 AND p_size % 5 > 4
""")
def rule_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rank slots, each blank for some parts; at least one filled, ranks up to 4."""
    part = _table(spark, sf_dir, "part")
    ranks = part.select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 7).alias("first"), F.when(F.col("p_size") % 2 != 0, F.col("p_size") % 5).alias("second"))
    rules = parse_rules("rules: [{id: r, type: rank, rank_variables: [first, second], max_rank_value: 4}]")
    found = validate(ranks, None, rules, key="p_partkey")
    return found.select(F.col("row_index").alias("p_partkey"), F.when(F.size("variables") > 1, "slots").otherwise(F.get("variables", F.lit(0))).alias("part"))


# domains --------------------------------------------------------------------


@_query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (0,1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19)")
def domain_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Codebook([SingleQuestion("c_nationkey", "Nation", categories=_codes(*range(20)))])
    return validate(_table(spark, sf_dir, "customer"), book, key="c_custkey").select(F.col("row_index").alias("c_custkey"))


@_query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 'below' ELSE 'above' END AS side FROM part WHERE p_size < 5 OR p_size > 45")
def domain_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Codebook([NumericQuestion("p_size", "Size", min_value=5, max_value=45)])
    found = validate(_table(spark, sf_dir, "part"), book, key="p_partkey")
    return found.select(F.col("row_index").alias("p_partkey"), F.when(F.contains("message", F.lit("below")), "below").otherwise("above").alias("side"))


@_query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) > 1000")
def domain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Codebook([TextQuestion("text", "Text", max_length=1000)])
    found = validate(_table(spark, sf_dir, "documents"), book, key="doc_id")
    return found.select(F.col("row_index").alias("doc_id"), F.regexp_extract("message", r" is (\d+) characters", 1).cast("bigint").alias("n"))


@_query(f"""
    SELECT o_orderkey, 'category' AS problem FROM ({_SELECTIONS}) WHERE list_contains(sel, 4)
    UNION ALL SELECT o_orderkey, 'max_selections' FROM ({_SELECTIONS}) WHERE len(sel) > 2
""")
def domain_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Codebook([MultiQuestion("sel", "Selection", categories=_codes(0, 1, 2, 3), max_selections=2)])
    found = validate(_selections(spark, sf_dir), book, key="o_orderkey")
    return found.select(F.col("row_index").alias("o_orderkey"), F.substring_index("rule_id", ":", -1).alias("problem"))


@_query("SELECT d.doc_id, 'required' AS problem FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL")
def domain_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Codebook([SingleQuestion("toxic", "Toxic", required=True, categories=_codes(0, 1))])
    found = validate(_labelled(spark, sf_dir), book, key="doc_id")
    return found.select(F.col("row_index").alias("doc_id"), F.substring_index("rule_id", ":", -1).alias("problem"))


@_query("SELECT c_custkey, 'type' AS problem FROM customer UNION ALL SELECT c_custkey, 'category' FROM customer UNION ALL SELECT c_custkey, 'type' FROM customer")
def domain_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of another kind than declared: a finding for every answer."""
    book = Codebook([NumericQuestion("c_name", "Name"), SingleQuestion("c_mktsegment", "Segment", categories=_codes(1)), TextQuestion("c_acctbal", "Balance")])
    found = validate(_table(spark, sf_dir, "customer"), book, key="c_custkey")
    return found.select(F.col("row_index").alias("c_custkey"), F.substring_index("rule_id", ":", -1).alias("problem"))


# expressions ----------------------------------------------------------------


@_query("SELECT p_partkey FROM part WHERE 10 <= p_size AND p_size <= 12")
def expr_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_table(spark, sf_dir, "part"), "rules: [{id: c, type: range, when: '10 <= p_size <= 12'}]", "p_partkey")


@_query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH') AND o_orderstatus NOT IN ('O','P')")
def expr_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = "o_orderpriority in ['1-URGENT', '2-HIGH'] and o_orderstatus not in ('O', 'P')"
    return _rows(_table(spark, sf_dir, "orders"), f'rules: [{{id: i, type: range, when: "{when}"}}]', "o_orderkey")


@_query("SELECT s_suppkey, abs(s_acctbal) AS a FROM supplier WHERE abs(s_acctbal) < 500")
def expr_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = _table(spark, sf_dir, "supplier")
    kept = supplier.where(compile_expression("abs(s_acctbal) < 500").condition(supplier.schema))
    return with_derived(kept, "a", compile_expression("abs(s_acctbal)")).select("s_suppkey", "a")


@_query("SELECT p_partkey FROM part WHERE contains(p_name, 'bolt')")
def expr_substring_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_table(spark, sf_dir, "part"), "rules: [{id: s, type: range, when: \"'bolt' in p_name\"}]", "p_partkey")


@_query("SELECT c_custkey, CAST((((c_nationkey - 12) % 7) + 7) % 7 AS BIGINT) AS m FROM customer")
def expr_floor_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_derived(_table(spark, sf_dir, "customer"), "m", compile_expression("(c_nationkey - 12) % 7")).select("c_custkey", "m")


@_query("SELECT c_custkey, CAST(CASE WHEN c_nationkey <> 0 THEN c_nationkey ELSE 99 END AS BIGINT) AS v, CAST(CASE WHEN c_nationkey % 2 <> 0 THEN c_custkey ELSE 0 END AS BIGINT) AS w FROM customer")
def expr_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``or`` and ``and`` return an operand."""
    both = with_derived(_table(spark, sf_dir, "customer"), "v", compile_expression("c_nationkey or 99"))
    return with_derived(both, "w", compile_expression("c_nationkey % 2 and c_custkey")).select("c_custkey", "v", "w")


@_query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR NOT (l.quality = 1)")
def expr_null_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_labelled(spark, sf_dir), "rules: [{id: n, type: range, when: 'quality == None or not quality == 1'}]", "doc_id")


@_query(f"SELECT o_orderkey FROM ({_SELECTIONS}) WHERE list_contains(sel, 2) AND NOT list_contains(sel, 3)")
def expr_selection_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_selections(spark, sf_dir), "rules: [{id: m, type: range, when: '2 in sel and 3 not in sel'}]", "o_orderkey")


# cleaning -------------------------------------------------------------------


@_query("SELECT c_custkey, CAST(CASE c_nationkey WHEN 0 THEN 100 WHEN 1 THEN 101 ELSE 999 END AS BIGINT) AS r FROM customer")
def recode_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("r"))
    return recode("r", {0: 100, 1: 101}, default=999)(rows, Codebook([]))


@_query("SELECT c_custkey, CAST(CASE c_nationkey WHEN 0 THEN 100 WHEN 1 THEN 101 ELSE c_nationkey END AS BIGINT) AS r FROM customer")
def recode_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("r"))
    return recode("r", {0: 100, 1: 101})(rows, Codebook([]))


@_query("SELECT l_orderkey, l_linenumber, l_extendedprice*(1-l_discount) AS net, l_extendedprice*(1-l_discount)*(1+l_tax) AS charge FROM lineitem")
def derived_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Codebook([
        DerivedVariable("charge", "Charge", expression="net * (1 + l_tax)", depends_on=("net",)),
        DerivedVariable("net", "Net", expression="l_extendedprice * (1 - l_discount)"),
    ])
    return run_pipeline(_table(spark, sf_dir, "lineitem"), book, [derive()]).select("l_orderkey", "l_linenumber", "net", "charge")


@_query(f"SELECT DISTINCT o_orderkey, unnest(sel) AS code FROM ({_SELECTIONS})")
def multi_selection_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selections(spark, sf_dir).select("o_orderkey", F.explode("sel").alias("code"))


@_query("""
    SELECT DISTINCT c_custkey, CAST(trim(tok) AS BIGINT) AS code
    FROM (SELECT c_custkey, unnest(string_split(concat(c_custkey % 4, ', ', c_nationkey % 3, ',,', c_custkey % 2), ',')) AS tok FROM customer) WHERE trim(tok) <> ''
""")
def multi_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("c_custkey") % 4, F.lit(", "), F.col("c_nationkey") % 3, F.lit(",,"), F.col("c_custkey") % 2)
    book = Codebook([MultiQuestion("Q", "Question", categories=_codes(0, 1, 2, 3))])
    rows = run_pipeline(_table(spark, sf_dir, "customer").select("c_custkey", text.alias("Q")), book, [expand_multi()])
    return rows.select("c_custkey", F.explode("Q").alias("code"))


@_query("""
    SELECT c_custkey, CAST(code AS BIGINT) AS code FROM (
        SELECT c_custkey, CASE WHEN c_nationkey % 2 = 1 THEN 1 END AS k1, CASE WHEN c_nationkey % 3 = 1 THEN 2 END AS k2, CASE WHEN c_nationkey % 5 = 1 THEN 3 END AS k3 FROM customer
    ) UNPIVOT (code FOR k IN (k1, k2, k3))
""")
def multi_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [(F.col("c_nationkey") % d == 1).cast("int").alias(f"Q_{k}") for k, d in ((1, 2), (2, 3), (3, 5))]
    book = Codebook([MultiQuestion("Q", "Question", categories=_codes(1, 2, 3))])
    rows = run_pipeline(_table(spark, sf_dir, "customer").select("c_custkey", *flags), book, [expand_multi()])
    return rows.select("c_custkey", F.explode("Q").alias("code"))


@_query("SELECT n_nationkey, n_name, CAST(NULL AS BIGINT) AS row_missing FROM nation")
def grid_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = GridQuestion("grid", "Grid", rows=tuple(SingleQuestion(i, i, categories=_codes(*range(25))) for i in ("n_nationkey", "row_missing")), columns=_codes(*range(25)))
    return complete_grids(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), Codebook([grid]))


# findings -------------------------------------------------------------------

_BOOK = Codebook([SingleQuestion("c_nationkey", "Nation", categories=_codes(*range(20)))])
_RULES = """
rules:
  - {id: bal_range, type: range, when: "c_acctbal < 0 or c_acctbal > 9900"}
  - {id: seg_check, type: range, severity: warning, when: "c_mktsegment == 'MACHINERY' and c_acctbal < 1000"}
"""
_ALL = """
    SELECT 'bal_range' AS rule_id, 'error' AS severity, c_custkey AS row_key FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9900
    UNION ALL SELECT '__domain__:c_nationkey:category', 'error', c_custkey FROM customer WHERE c_nationkey NOT BETWEEN 0 AND 19
    UNION ALL SELECT 'seg_check', 'warning', c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 1000
"""


def _all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(_table(spark, sf_dir, "customer"), _BOOK, parse_rules(_RULES), key="c_custkey")


@_query(_ALL)
def validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_findings(spark, sf_dir).select("rule_id", "severity", F.col("row_index").alias("row_key"))


@_query(f"SELECT * FROM ({_ALL}) WHERE severity = 'warning'")
def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Findings(_all_findings(spark, sf_dir)).by_severity("warning").frame.select("rule_id", "severity", F.col("row_index").alias("row_key"))


@_query(f"SELECT * FROM ({_ALL}) WHERE rule_id = 'bal_range'")
def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Findings(_all_findings(spark, sf_dir)).by_rule("bal_range").frame.select("rule_id", "severity", F.col("row_index").alias("row_key"))


@_query("SELECT event_type AS rule_id, count(*) AS n FROM events WHERE value > 100 GROUP BY 1")
def report_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_rule(_event_findings(spark, sf_dir, "value > 100")).select("rule_id", "n")


@_query(f"SELECT rule_id, severity, count(*) AS n FROM ({_ALL}) GROUP BY 1, 2")
def report_validate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_rule(_all_findings(spark, sf_dir))


@_query("""
    SELECT v.severity, CAST(count(e.sev) AS BIGINT) AS n FROM (VALUES ('info'), ('warning'), ('error')) v(severity)
    LEFT JOIN (SELECT CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS sev FROM events WHERE value > 100) e ON e.sev = v.severity GROUP BY v.severity
""")
def report_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.by_severity(_event_findings(spark, sf_dir, "value > 100"))


def _event_findings(spark: SparkSession, sf_dir: str, when: str) -> DataFrame:
    """Events as findings, each under its own type's name."""
    events = _table(spark, sf_dir, "events")
    found = validate(events, None, parse_rules(f'rules: [{{id: e, type: range, when: "{when}"}}]'), key="event_id", keep=["event_type"])
    severity = F.when(F.col("event_type") == "error", "error").otherwise("info")
    return found.withColumns({"rule_id": F.col("event_type"), "severity": severity}).drop("event_type")


_LEGACY = "SELECT DISTINCT event_type AS k FROM events"
_NEW = "SELECT DISTINCT event_type AS k FROM events WHERE value > 400 AND event_type <> 'signup'"


def _shadow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = _table(spark, sf_dir, "events").select(F.col("event_type").alias("k"))
    return old, _event_findings(spark, sf_dir, "value > 400 and event_type != 'signup'").select(F.col("rule_id").alias("k"))


@_query(f"{_LEGACY} EXCEPT {_NEW}")
def shadow_legacy_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _shadow(spark, sf_dir)
    return shadow.only_in(old, new, "k")


@_query(f"{_NEW} EXCEPT SELECT DISTINCT event_type AS k FROM events WHERE event_type = 'signup'")
def shadow_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _shadow(spark, sf_dir)
    return shadow.only_in(new, _table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_type").alias("k")), "k")


@_query(f"{_LEGACY} INTERSECT {_NEW}")
def shadow_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _shadow(spark, sf_dir)
    return shadow.in_both(old, new, "k")
