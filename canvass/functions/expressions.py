"""The expression language of rules and derived variables, compiled to Catalyst columns.

Text is parsed by ``ast``, checked against a whitelist, and turned into a Column with the types of
the table at hand. Nothing is ever evaluated by Python. Values follow Python's meaning: a null
equals a null, ``and``/``or`` return an operand, ``%`` takes the sign of the divisor, emptiness and
zero are false. What Python refuses (arithmetic on text, order between types) is refused when the
column is built; what depends on the data (a null in arithmetic) raises in strict mode and is null
in lenient mode.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RuleEvaluationError, RuleParseError, UnknownVariableError, UnsafeExpressionError

MAX_NODES = 200
STRICT, LENIENT = "strict", "lenient"

_ALLOWED = (
    ast.Expression, ast.Constant, ast.Name, ast.Load, ast.BoolOp, ast.And, ast.Or, ast.UnaryOp, ast.Not, ast.USub, ast.UAdd,
    ast.BinOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.Compare, ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE,
    ast.In, ast.NotIn, ast.List, ast.Tuple, ast.Set, ast.Call,
)

NUM, TEXT, FLAG, SET, NONE, ITEMS = "number", "text", "boolean", "selection", "none", "list"


@dataclass
class Typed:
    """A column with its kind. ``items``: the members of a literal collection. ``risky``: evaluating
    it may raise, so it must not run where Python would not have reached it."""

    col: Column
    kind: str
    items: tuple[Typed, ...] = ()
    risky: bool = False
    literal: bool = False
    element: str = NUM
    whole: bool = False


def _kind_of(data_type: T.DataType) -> tuple[str, str]:
    if isinstance(data_type, T.BooleanType):
        return FLAG, NUM
    if isinstance(data_type, T.NumericType):
        return NUM, NUM
    if isinstance(data_type, T.StringType | T.CharType | T.VarcharType):
        return TEXT, NUM
    if isinstance(data_type, T.ArrayType):
        inner = _kind_of(data_type.elementType)[0]
        return SET, inner
    if isinstance(data_type, T.NullType):
        return NONE, NUM
    raise RuleEvaluationError(f"columns of type {data_type.simpleString()} can't be used in expressions")


def _raise(message: str) -> Column:
    return F.raise_error(F.lit(f"RuleEvaluationError: {message}"))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def canonical(col: Column) -> Column:
    """A multi-response selection as a set: sorted and without repeats."""
    return F.array_sort(F.array_distinct(col))


class CompiledExpression:
    """A checked expression. ``column`` gives its value, ``condition`` its truth, for a schema."""

    def __init__(self, source: str, tree: ast.Expression, functions: Mapping[str, Callable[..., Column]]) -> None:
        self.source, self._tree, self._functions = source, tree, dict(functions)

    def __repr__(self) -> str:
        return f"CompiledExpression({self.source!r})"

    @property
    def names(self) -> tuple[str, ...]:
        calls = {id(n.func) for n in ast.walk(self._tree) if isinstance(n, ast.Call)}
        return tuple(dict.fromkeys(n.id for n in ast.walk(self._tree) if isinstance(n, ast.Name) and id(n) not in calls))

    def _build(self, schema: T.StructType, mode: str) -> _Builder:
        return _Builder(schema, self._functions, mode == STRICT, self.source)

    def typed(self, schema: T.StructType, mode: str = STRICT) -> Typed:
        return self._build(schema, mode).value(self._tree.body)

    def column(self, schema: T.StructType, mode: str = STRICT) -> Column:
        return self.typed(schema, mode).col

    def condition(self, schema: T.StructType, mode: str = STRICT) -> Column:
        return self._build(schema, mode).truth(self._tree.body)[0]

    def evaluate(self, spark: SparkSession, variables: Mapping[str, Any], mode: str = STRICT) -> Any:
        """The value for one row of variables; for trying things out."""
        fields = [T.StructField(k, _type_of(v)) for k, v in variables.items()]
        row = tuple(sorted(v) if isinstance(v, set | frozenset) else list(v) if isinstance(v, tuple) else v for v in variables.values())
        frame = spark.createDataFrame([(*row, 0)], T.StructType([*fields, T.StructField("_one", T.IntegerType())]))
        return evaluated(lambda: frame.select(self.column(frame.schema, mode).alias("v")).first()[0])


def _type_of(value: Any) -> T.DataType:
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, list | tuple | set | frozenset):
        return T.ArrayType(_type_of(next(iter(value), 0)))
    return T.NullType() if value is None else T.StringType()


_MARKS = ("RuleEvaluationError:", "DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO", "ARITHMETIC_OVERFLOW", "TransformationError:")


def evaluated(action: Callable[[], Any]) -> Any:
    """Runs an action; failures that the data caused in an expression become our errors."""
    from ..errors import TransformationError

    try:
        return action()
    except Exception as e:
        text = str(e)
        for mark in _MARKS:
            if mark in text:
                said = text[text.index(mark) :].splitlines()[0][:300]
                raise (TransformationError if mark.startswith("Trans") else RuleEvaluationError)(said) from e
        raise


def compile_expression(source: str, *, functions: Mapping[str, Callable[..., Column]] | None = None) -> CompiledExpression:
    """Parses and checks ``source``. ``functions`` maps names to builders of columns from columns."""
    known: dict[str, Callable[..., Column]] = {"abs": F.abs} | dict(functions or {})
    try:
        tree = ast.parse(source.strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise RuleParseError(f"can't parse expression {source!r}: {e}") from e
    try:
        nodes = list(ast.walk(tree))
    except RecursionError as e:
        raise RuleParseError("the expression is nested too deeply") from e
    if len(nodes) > MAX_NODES:
        raise RuleParseError(f"the expression has {len(nodes)} parts; at most {MAX_NODES} are allowed")
    for node in nodes:
        if not isinstance(node, _ALLOWED):
            raise UnsafeExpressionError(f"{type(node).__name__} is not allowed in expressions")
        if isinstance(node, ast.Constant) and not (node.value is None or type(node.value) in (bool, int, float, str)):
            raise UnsafeExpressionError(f"a constant of type {type(node.value).__name__} is not allowed")
        if isinstance(node, ast.Call):
            if not isinstance(node.func, ast.Name) or node.func.id not in known:
                raise UnsafeExpressionError("only known functions may be called")
            if node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
                raise UnsafeExpressionError("functions take positional arguments only")
    return CompiledExpression(source, tree, known)


_SYMBOL = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


class _Builder:
    def __init__(self, schema: T.StructType, functions: Mapping[str, Callable[..., Column]], strict: bool, source: str) -> None:
        self.types = {f.name: f.dataType for f in schema.fields}
        self.functions, self.strict, self.source = functions, strict, source

    # values -----------------------------------------------------------------

    def value(self, node: ast.AST) -> Typed:
        match node:
            case ast.Constant(value=v):
                return self._constant(v)
            case ast.Name(id=name):
                return self._name(name)
            case ast.BoolOp(op=op, values=values):
                return reduce(lambda a, b: self._either(isinstance(op, ast.Or), a, b), [self.value(v) for v in values])
            case ast.UnaryOp(op=ast.Not(), operand=x):
                col, risky = self.truth(x)
                return Typed(~col, FLAG, risky=risky)
            case ast.UnaryOp(op=op, operand=x):
                a = self._number(self.value(x))
                col = self._guard([a], -a.col if isinstance(op, ast.USub) else a.col)
                return Typed(col, NUM, risky=a.risky or self.strict and not a.literal, literal=a.literal, whole=a.whole)
            case ast.BinOp(left=x, op=op, right=y):
                return self._arithmetic(type(op), self.value(x), self.value(y))
            case ast.Compare():
                col, risky = self.truth(node)
                return Typed(col, FLAG, risky=risky)
            case ast.List(elts=elts) | ast.Tuple(elts=elts) | ast.Set(elts=elts):
                items = tuple(self.value(e) for e in elts)
                kinds = {i.kind for i in items if i.kind != NONE}
                col = F.array(*[i.col for i in items]) if len(kinds) <= 1 and kinds <= {NUM, TEXT, FLAG} else F.lit(None)
                return Typed(col, ITEMS, items, risky=any(i.risky for i in items), element=next(iter(kinds), NUM))
            case ast.Call(func=ast.Name(id=name), args=args):
                return self._call(name, [self.value(a) for a in args])
        raise UnsafeExpressionError(f"{type(node).__name__} is not allowed in expressions")

    def _constant(self, v: Any) -> Typed:
        if v is None:
            return Typed(F.lit(None), NONE, literal=True)
        if isinstance(v, bool):
            return Typed(F.lit(v), FLAG, literal=True)
        if isinstance(v, int):
            if not -(1 << 63) <= v < 1 << 63:
                raise RuleEvaluationError(f"the number {v} needs more than 64 bits")
            return Typed(F.lit(v).cast("bigint"), NUM, literal=True, whole=True)
        if isinstance(v, float):
            return Typed(F.lit(v), NUM, literal=True)
        return Typed(F.lit(v), TEXT, literal=True)

    def _name(self, name: str) -> Typed:
        if name not in self.types:
            raise UnknownVariableError(f"expression {self.source!r} uses unknown variable {name!r}")
        kind, element = _kind_of(self.types[name])
        col, whole = quoted(name), isinstance(self.types[name], T.IntegralType)
        if whole:
            col = col.cast("bigint")
        elif isinstance(self.types[name], T.FloatType | T.DecimalType):
            col = col.cast("double")
        return Typed(col, kind, element=element, whole=whole)

    def _either(self, is_or: bool, a: Typed, b: Typed) -> Typed:
        test = self._truthy(a)
        if a.kind == b.kind or NONE in (a.kind, b.kind):
            first, second = a.col, b.col
        elif {a.kind, b.kind} <= {SET, ITEMS}:
            first, second = a.col, b.col
        elif {a.kind, b.kind} == {NUM, FLAG}:  # True is 1
            first, second = self._as_number(a), self._as_number(b)
            a = Typed(first, NUM, risky=a.risky, whole=a.whole or a.kind == FLAG)
            b = Typed(second, NUM, risky=b.risky, whole=b.whole or b.kind == FLAG)
        else:
            raise RuleEvaluationError(f"and/or between {a.kind} and {b.kind} has no single type in {self.source!r}")
        col = F.when(test, first if is_or else second).otherwise(second if is_or else first)
        return Typed(col, b.kind if a.kind == NONE else a.kind, risky=a.risky or b.risky, whole=a.whole and b.whole, element=a.element)

    def _number(self, a: Typed) -> Typed:
        if a.kind != NUM:
            raise RuleEvaluationError(f"arithmetic needs numbers, not {a.kind}, in {self.source!r}")
        return a

    def _guard(self, operands: list[Typed], col: Column) -> Column:
        """In strict mode a null operand is an error."""
        loose = [x.col.isNull() for x in operands if not x.literal]
        if not self.strict or not loose:
            return col
        return F.when(reduce(lambda x, y: x | y, loose), _raise(f"a value is missing in {self.source}")).otherwise(col)

    def _arithmetic(self, op: type, a: Typed, b: Typed) -> Typed:
        self._number(a), self._number(b)
        x, y = a.col, b.col
        whole = a.whole and b.whole and op is not ast.Div
        if op is ast.Add:
            col = x + y
        elif op is ast.Sub:
            col = x - y
        elif op is ast.Mult:
            col = x * y
        else:
            zero = F.lit(None) if not self.strict else _raise(f"division by zero in {self.source}")
            safe = F.when(y == 0, F.lit(None).cast("double")).otherwise(y.cast("double")) if op is ast.Div else F.when(y == 0, F.lit(None)).otherwise(y)
            if op is ast.Div:
                col = x.cast("double") / safe
            else:
                r = x % safe
                col = F.when((r != 0) & ((r < 0) != (safe < 0)), r + safe).otherwise(r)
            if self.strict:
                col = F.when(y == 0, zero).otherwise(col)
        return Typed(self._guard([a, b], col), NUM, risky=a.risky or b.risky or self.strict, whole=whole)

    def _call(self, name: str, args: list[Typed]) -> Typed:
        if name == "abs" and self.functions[name] is F.abs:
            if len(args) != 1 or args[0].kind not in (NUM, FLAG):
                raise RuleEvaluationError(f"abs takes one number in {self.source!r}")
            a = args[0]
            col = F.abs(a.col.cast("bigint") if a.kind == FLAG else a.col)
            return Typed(self._guard([a], col), NUM, risky=a.risky or self.strict and not a.literal, whole=a.whole or a.kind == FLAG)
        col = self.functions[name](*[a.col for a in args])
        kind = getattr(self.functions[name], "kind", NUM)
        return Typed(col, kind, risky=True)

    # truth ------------------------------------------------------------------

    def _truthy(self, a: Typed) -> Column:
        match a.kind:
            case "none":
                return F.lit(False)
            case "boolean":
                test = a.col
            case "number":
                test = a.col != 0
            case "text":
                test = F.length(a.col) > 0
            case "list":
                return F.lit(len(a.items) > 0)
            case _:
                test = F.size(a.col) > 0
        return F.coalesce(test, F.lit(False))

    def truth(self, node: ast.AST) -> tuple[Column, bool]:
        """(never null) truth of a node, and whether it may raise."""
        match node:
            case ast.BoolOp(op=op, values=values):
                col, risky = self.truth(values[0])
                for v in values[1:]:
                    nxt, more = self.truth(v)
                    if isinstance(op, ast.Or):
                        col = F.when(col, F.lit(True)).otherwise(nxt) if more else col | nxt
                    else:
                        col = F.when(col, nxt).otherwise(F.lit(False)) if more else col & nxt
                    risky |= more
                return col, risky
            case ast.UnaryOp(op=ast.Not(), operand=x):
                col, risky = self.truth(x)
                return ~col, risky
            case ast.Compare(left=left, ops=ops, comparators=rights):
                col: Column | None = None
                risky = False
                a = self.value(left)
                for op, right in zip(ops, rights, strict=True):
                    b = self.value(right)
                    step, more = self._compare(type(op), a, b)
                    more |= a.risky or b.risky
                    if col is None:
                        col = step
                    else:
                        col = F.when(col, step).otherwise(F.lit(False)) if more else col & step
                    risky |= more
                    a = b
                return col, risky
        a = self.value(node)
        return self._truthy(a), a.risky

    def _compare(self, op: type, a: Typed, b: Typed) -> tuple[Column, bool]:
        if op is ast.Eq or op is ast.NotEq:
            same = self._equal(a, b)
            return (same if op is ast.Eq else ~same), False
        if op is ast.In or op is ast.NotIn:
            col, risky = self._within(a, b)
            return (col if op is ast.In else ~col), risky
        return self._ordered(op, a, b)

    def _equal(self, a: Typed, b: Typed) -> Column:
        if a.kind == ITEMS or b.kind == ITEMS:
            if a.kind == b.kind:
                if len(a.items) != len(b.items):
                    return F.lit(False)
                return reduce(lambda x, y: x & y, [self._equal(x, y) for x, y in zip(a.items, b.items, strict=True)], F.lit(True))
            whole, other = (a, b) if a.kind == ITEMS else (b, a)
            if other.kind == SET and whole.element == other.element and len(whole.items):
                return canonical(other.col).eqNullSafe(canonical(whole.col))
            return F.coalesce(F.size(other.col) == 0, F.lit(False)) if other.kind == SET and not whole.items else F.lit(False)
        if a.kind == NONE and b.kind == NONE:
            return F.lit(True)
        if a.kind == NONE:
            return b.col.isNull()
        if b.kind == NONE:
            return a.col.isNull()
        if a.kind == b.kind == SET:
            return canonical(a.col).eqNullSafe(canonical(b.col)) if a.element == b.element else a.col.isNull() & b.col.isNull()
        if {a.kind, b.kind} == {NUM, FLAG}:
            return self._as_number(a).eqNullSafe(self._as_number(b))
        if a.kind == b.kind:
            return a.col.eqNullSafe(b.col)
        return F.lit(False) if a.literal or b.literal else a.col.isNull() & b.col.isNull()

    @staticmethod
    def _as_number(a: Typed) -> Column:
        return a.col.cast("bigint") if a.kind == FLAG else a.col

    def _within(self, a: Typed, b: Typed) -> tuple[Column, bool]:
        if b.kind == ITEMS:
            plain = [i for i in b.items if i.literal and i.kind == a.kind and a.kind in (NUM, TEXT)]
            rest = [i for i in b.items if not any(i is p for p in plain)]
            tests = [self._equal(a, i) for i in rest]
            if plain:
                tests.insert(0, a.col.isNotNull() & a.col.isin(*[i.col for i in plain]))
            return (reduce(lambda x, y: x | y, tests) if tests else F.lit(False)), False
        if b.kind == TEXT:
            if a.kind != TEXT:
                raise RuleEvaluationError(f"only text can be in text in {self.source!r}")
            return self._settled([a, b], F.contains(b.col, a.col))
        if b.kind == SET:
            if a.kind == NONE:
                found = F.exists(b.col, lambda x: x.isNull())
            elif a.kind in (NUM, FLAG) and b.element in (NUM, FLAG) or a.kind == b.element:
                left = self._as_number(a)
                found = F.exists(b.col, lambda x: (x.cast("bigint") if b.element == FLAG else x).eqNullSafe(left))
            else:
                found = F.when(b.col.isNotNull(), F.lit(False))
            return self._settled([b], found)
        raise RuleEvaluationError(f"'in' needs a list, a selection or text on its right in {self.source!r}")

    def _settled(self, operands: list[Typed], col: Column) -> tuple[Column, bool]:
        risky = self.strict and not all(x.literal for x in operands)
        if risky:
            return F.coalesce(self._guard(operands, col), F.lit(False)), True
        # Written with null tests instead of coalesce(), so that a scan can take the filter.
        whole = any(x.kind in (SET, ITEMS) for x in operands)
        tests = [x.col.isNotNull() for x in operands if not x.literal]
        return reduce(lambda x, y: x & y, [*tests, F.coalesce(col, F.lit(False)) if whole else col]), False

    def _ordered(self, op: type, a: Typed, b: Typed) -> tuple[Column, bool]:
        sign = _SYMBOL[op]
        if a.kind in (SET, ITEMS) and b.kind in (SET, ITEMS):
            if sign in (">", ">="):
                a, b, sign = b, a, "<" if sign == ">" else "<="
            inside = F.size(F.array_except(a.col, b.col)) == 0
            if sign == "<":
                inside = inside & (F.size(F.array_distinct(a.col)) < F.size(F.array_distinct(b.col)))
            return self._settled([a, b], inside)
        if not (a.kind == b.kind == TEXT or {a.kind, b.kind} <= {NUM, FLAG}):
            raise RuleEvaluationError(f"{a.kind} and {b.kind} have no order in {self.source!r}")
        x, y = (self._as_number(a), self._as_number(b)) if a.kind != TEXT else (a.col, b.col)
        col = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]
        return self._settled([a, b], col)


def with_derived(df: DataFrame, name: str, expression: CompiledExpression, mode: str = STRICT) -> DataFrame:
    return df.withColumn(name, expression.column(df.schema, mode))
