"""What a run stores: cleaned tables and findings, as Parquet, with JSON for other tools."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import TransformationError
from .tables import ROW_INDEX, table_from_columns

SET_TAG = "__frozenset__"


def save_table(df: DataFrame, path: str | Path) -> None:
    df.write.mode("overwrite").parquet(str(path))


def load_table(spark: SparkSession, path: str | Path) -> DataFrame:
    try:
        return spark.read.parquet(str(path))
    except Exception as e:
        raise TransformationError(f"can't read stored table {path}: {str(e).splitlines()[0]}") from e


save_findings, load_findings = save_table, load_table


def write_atomically(path: str | Path, text: str) -> None:
    """Writes beside the file and then replaces it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=path.name, suffix=".tmp")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    Path(name).replace(path)


def _coded(value: Any) -> Any:
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, list) and all(v is None or isinstance(v, bool | int | float | str) for v in value):
        return {SET_TAG: sorted(value, key=repr)}
    raise TransformationError(f"a value of type {type(value).__name__} can't be stored as JSON")


def export_table_json(df: DataFrame, path: str | Path) -> None:
    """{row_count, columns} with selections tagged; rows pass through the driver one by one."""
    if ROW_INDEX in df.columns:
        df = df.orderBy(ROW_INDEX).drop(ROW_INDEX)
    columns: dict[str, list] = {c: [] for c in df.columns}
    n = 0
    for row in df.toLocalIterator():
        n += 1
        for c, v in zip(df.columns, row, strict=True):
            columns[c].append(_coded(v))
    write_atomically(path, json.dumps({"row_count": n, "columns": columns}))


def import_table_json(spark: SparkSession, path: str | Path) -> DataFrame:
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        plain = lambda v: frozenset(v[SET_TAG]) if isinstance(v, dict) else v
        columns = {str(c): [plain(v) for v in values] for c, values in data["columns"].items()}
        count = int(data["row_count"])
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise TransformationError(f"{path} is not a stored table: {e}") from e
    return table_from_columns(spark, columns, count)


def export_findings_json(findings: DataFrame, path: str | Path) -> None:
    from ..operators.validate import ORDER

    rows = findings.orderBy(*[c for c in ORDER if c in findings.columns]).toLocalIterator()
    fields = ("rule_id", "severity", "message", "row_index", "variables")
    write_atomically(path, json.dumps([{k: r[k] for k in fields} for r in rows]))


def import_findings_json(spark: SparkSession, path: str | Path) -> DataFrame:
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        rows = [(d["rule_id"], d["severity"], d["message"], d["row_index"], list(d["variables"]), k, 0) for k, d in enumerate(data)]
    except (ValueError, KeyError, TypeError) as e:
        raise TransformationError(f"{path} holds no findings: {e}") from e
    return spark.createDataFrame(rows, "rule_id string, severity string, message string, row_index bigint, variables array<string>, check_ord int, var_ord int")
