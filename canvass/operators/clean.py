"""Cleaning steps: functions from (table, codebook) to a table, all lazy."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CanvassError, TransformationError, UnknownVariableError
from ..functions.expressions import STRICT, canonical, compile_expression, quoted
from ..plans.codebook import Codebook, GridQuestion, MultiQuestion

Step = Callable[[DataFrame, Codebook], DataFrame]


def _raise(message: str) -> Column:
    return F.raise_error(F.lit(f"TransformationError: {message}"))


def run_pipeline(df: DataFrame, codebook: Codebook, steps: Sequence[Step]) -> DataFrame:
    """The steps in order; one plan."""
    return reduce(lambda d, step: step(d, codebook), steps, df)


def complete_grids(df: DataFrame, codebook: Codebook) -> DataFrame:
    """Adds an empty column for each row of a grid that has none."""
    missing = {r.id: F.lit(None).cast(r.spark_type()) for q in codebook.top_level if isinstance(q, GridQuestion) for r in q.rows if r.id not in df.columns}
    return df.withColumns(missing) if missing else df


def _delimited(name: str, delimiter: str) -> Column:
    col = F.regexp_replace(quoted(name), r"(?U)^\s+|\s+$", "")
    tokens = F.transform(F.split(col, f"\\Q{delimiter}\\E", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    codes = F.transform(F.filter(tokens, lambda x: x != ""), lambda x: F.coalesce(x.try_cast("bigint"), F.when(F.lit(True), _raise(f"{name} holds something that is no whole number"))))
    return F.when(F.length(col) > 0, canonical(codes))


def _indicators(question: MultiQuestion, types: Mapping[str, T.DataType]) -> Column:
    absent, chosen = [], []
    for c in question.categories:
        name = f"{question.id}_{c.code}"
        col = quoted(name)
        if isinstance(types[name], T.BooleanType):
            text = F.when(col, "1").otherwise(F.when(~col, "0"))
        elif isinstance(types[name], T.NumericType):
            text = F.when(col == 1, "1").when(col == 0, "0").otherwise(col.cast("string"))
        else:
            text = F.when(col != "", col)
        on = F.when(text == "1", F.lit(True)).when(text.isNull() | (text == "0"), F.lit(False)).otherwise(_raise(f"{name} holds something that is neither 0 nor 1"))
        absent.append(text.isNull())
        chosen.append(F.when(on, F.lit(c.code).cast("bigint")))
    picked = F.filter(F.array(*chosen), lambda x: x.isNotNull())
    return F.when(reduce(lambda x, y: x & y, absent), F.lit(None)).otherwise(canonical(picked))


def expand_multi(delimiter: str = ",") -> Step:
    """Multi-response answers as sorted sets of codes.

    ``Q`` as text of codes is split; columns ``Q_<code>`` for all codes are merged into ``Q`` and
    dropped; a column that holds selections already is left alone, as is an incomplete set of
    indicators. A blank answer is null, all indicators off is an empty set.
    """

    def step(df: DataFrame, codebook: Codebook) -> DataFrame:
        for q in codebook:
            if not isinstance(q, MultiQuestion):
                continue
            types = {f.name: f.dataType for f in df.schema.fields}
            if q.id in types:
                if isinstance(types[q.id], T.ArrayType | T.NullType):
                    continue
                if not isinstance(types[q.id], T.StringType):
                    raise TransformationError(f"{q.id} must hold text to be split, not {types[q.id].simpleString()}")
                df = df.withColumn(q.id, _delimited(q.id, delimiter))
            elif all(f"{q.id}_{c.code}" in types for c in q.categories):
                names = [f"{q.id}_{c.code}" for c in q.categories]
                df = df.select(*[quoted(c) for c in df.columns if c not in names], _indicators(q, types).alias(q.id))
        return df

    return step


def recode(variable: str, mapping: Mapping[int, int], default: int | None = None) -> Step:
    """Replaces codes; others become ``default``, or stay where that is None. Nulls stay."""

    def step(df: DataFrame, codebook: Codebook) -> DataFrame:
        if variable not in df.columns:
            raise UnknownVariableError(f"can't recode unknown variable {variable!r}")
        t, col = df.schema[variable].dataType, quoted(variable)
        if isinstance(t, T.NullType):
            return df
        if not isinstance(t, T.NumericType):
            raise TransformationError(f"can't recode {variable}: {t.simpleString()} is not a whole number")
        code = col.cast("bigint")
        if not isinstance(t, T.IntegralType):
            code = F.when(col == F.floor(col), code).when(col.isNotNull(), _raise(f"{variable} holds a fraction"))
        new = F.lit(default).cast("bigint") if default is not None else code
        for old, to in reversed(list(mapping.items())):
            new = F.when(code == old, F.lit(to).cast("bigint")).otherwise(new)
        return df.withColumn(variable, F.when(col.isNotNull(), new))

    return step


def derive(mode: str = STRICT) -> Step:
    """Adds derived variables, each after all it depends on; a column of that name is replaced."""

    def step(df: DataFrame, codebook: Codebook) -> DataFrame:
        for d in codebook.derived_variables:
            try:
                value = compile_expression(d.expression).column(df.schema, mode)
            except CanvassError as e:
                raise TransformationError(f"can't derive {d.id!r}: {e}") from e
            df = df.withColumn(d.id, value)
        return df

    return step


def coerce_to_codebook(df: DataFrame, codebook: Codebook) -> DataFrame:
    """Text columns of numeric and single questions as numbers where they can be read as such; an
    extension, not part of the default steps. Cells that can't be read become null."""
    casts = {}
    for q in codebook:
        if q.id in df.columns and isinstance(df.schema[q.id].dataType, T.StringType) and isinstance(q.spark_type(), T.LongType | T.DoubleType):
            casts[q.id] = quoted(q.id).try_cast(q.spark_type().simpleString())
    return df.withColumns(casts) if casts else df


def default_steps(mode: str = STRICT) -> tuple[Step, ...]:
    """Selections first, so that indicators of a grid's rows are merged before missing rows are added."""
    return (expand_multi(), complete_grids, derive(mode))
