"""Reading tables: CSV in two ways, Parquet and JSON; and tables held in memory."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence
from enum import StrEnum
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import DataLoadError, UnknownColumnError, UnsupportedFormatError
from ..functions.expressions import quoted
from ..operators.validate import ROW_INDEX


class DataFormat(StrEnum):
    CSV = "csv"
    EXCEL = "excel"
    JSON = "json"
    PARQUET = "parquet"


SUFFIXES = {".csv": DataFormat.CSV, ".xlsx": DataFormat.EXCEL, ".xls": DataFormat.EXCEL, ".json": DataFormat.JSON, ".parquet": DataFormat.PARQUET}


def sniff_format(path: str | Path) -> DataFormat:
    suffix = Path(str(path)).suffix.lower()
    if suffix not in SUFFIXES:
        raise UnsupportedFormatError(f"can't tell the format of {path} from {suffix!r}")
    return SUFFIXES[suffix]


def csv_header(path: str | Path, encoding: str) -> list[str]:
    """The header, checked: the file must be readable, have a header, and name no column twice."""
    try:
        with open(path, encoding=encoding, newline="") as f:
            header = next(csv.reader(f), None)
    except (OSError, UnicodeDecodeError, csv.Error, LookupError) as e:
        raise DataLoadError(f"can't read {path}: {e}") from e
    if not header:
        raise DataLoadError(f"{path} has no header")
    if twice := sorted({c for c in header if header.count(c) > 1}):
        raise DataLoadError(f"{path} names columns twice: {twice}")
    return header


class _ExactReader(DataSourceReader):
    def __init__(self, path: str, encoding: str, columns: list[str]) -> None:
        self.path, self.encoding, self.columns = path, encoding, columns

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        width = len(self.columns)
        with open(self.path, encoding=self.encoding, newline="") as f:
            rows = csv.reader(f)
            next(rows, None)
            index = 0
            for row in rows:
                if row:  # lines without any cell are passed over
                    yield (*row[:width], *[None] * (width - len(row)), index)
                    index += 1


class ExactCsv(DataSource):
    """CSV cells as they stand: an empty cell is empty text, only a missing one is null. One partition,
    as quoted line breaks leave no safe place to cut; rows keep their order."""

    @classmethod
    def name(cls) -> str:
        return "exact_csv"

    def schema(self) -> T.StructType:
        columns = csv_header(self.options["path"], self.options.get("encoding", "utf-8-sig"))
        return T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField(ROW_INDEX, T.LongType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ExactReader(self.options["path"], self.options.get("encoding", "utf-8-sig"), [f.name for f in schema.fields if f.name != ROW_INDEX])


def load_csv(spark: SparkSession, path: str | Path, *, encoding: str = "utf-8-sig", mode: str = "exact") -> DataFrame:
    """All cells as text, plus the row's place as ``_row_index`` (exact mode).

    ``exact`` parses in one Python task and tells empty cells from missing ones; ``fast`` uses
    Spark's own parser, in which both are null and which runs in parallel unless cells hold line breaks.
    """
    columns = csv_header(path, encoding)
    if mode == "fast":
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        charset = "UTF-8" if encoding.lower().replace("_", "-") in ("utf-8", "utf-8-sig") else encoding
        return spark.read.csv(str(path), schema=schema, header=True, enforceSchema=True, escape='"', encoding=charset)
    try:
        with open(path, encoding=encoding, newline="") as f:
            for _ in csv.reader(f):
                pass
    except (UnicodeDecodeError, csv.Error) as e:
        raise DataLoadError(f"can't read {path}: {e}") from e
    spark.dataSource.register(ExactCsv)
    return spark.read.format("exact_csv").option("path", str(path)).option("encoding", encoding).load()


def load_file(spark: SparkSession, path: str | Path, *, encoding: str = "utf-8-sig", mode: str = "exact") -> DataFrame:
    """A table by the suffix of its path."""
    match sniff_format(path):
        case DataFormat.CSV:
            return load_csv(spark, path, encoding=encoding, mode=mode)
        case DataFormat.PARQUET:
            return normalized(spark.read.parquet(str(path)))
        case DataFormat.JSON:
            return normalized(spark.read.json(str(path)))
    raise UnsupportedFormatError(f"reading {sniff_format(path)} files is not supported: {path}")


def normalized(df: DataFrame) -> DataFrame:
    """NaN as null in floating-point columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)]
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats}) if floats else df


def table_from_columns(spark: SparkSession, columns: Mapping[str, Sequence[Any]], row_count: int, schema: T.StructType | str | None = None) -> DataFrame:
    """A table held in memory, by columns. Ragged columns and negative counts are refused."""
    if row_count < 0:
        raise DataLoadError("a table can't have a negative number of rows")
    for name, values in columns.items():
        if len(values) != row_count:
            raise DataLoadError(f"column {name!r} has {len(values)} values, not {row_count}")
    if not columns:
        return spark.range(row_count).select(F.col("id").alias(ROW_INDEX))
    plain = lambda v: sorted(v) if isinstance(v, set | frozenset) else list(v) if isinstance(v, tuple) else v
    rows = [(*[plain(v) for v in row], k) for k, row in enumerate(zip(*columns.values(), strict=True))]
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)  # type: ignore[attr-defined]
    if schema is None:
        schema = T.StructType([T.StructField(n, _guess(v)) for n, v in columns.items()])
    return normalized(spark.createDataFrame(rows, T.StructType([*schema.fields, T.StructField(ROW_INDEX, T.LongType())])))


def _guess(values: Sequence[Any]) -> T.DataType:
    from ..functions.expressions import _type_of

    kinds = {type(_type_of(v)): _type_of(v) for v in values if v is not None}
    if not kinds:
        return T.StringType()
    if set(kinds) == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    if len(kinds) > 1:
        raise DataLoadError(f"a column mixes kinds of values: {sorted(k.__name__ for k in kinds)}")
    return next(iter(kinds.values()))


def column(df: DataFrame, name: str) -> DataFrame:
    """One column, by its exact name."""
    if name not in df.columns:
        raise UnknownColumnError(f"no column {name!r}; there are {df.columns}")
    return df.select(quoted(name))


def to_records(df: DataFrame) -> list[dict[str, Any]]:
    """All rows on the driver; for small tables only."""
    return [r.asDict() for r in df.drop(ROW_INDEX).collect()]
