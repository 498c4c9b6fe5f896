"""Shared scratch space: written tables cut lineage and survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset, one of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="canvass-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is there when the application ends is deleted."""
    path = f"{shared_dir(spark)}/canvass/{name}-{uuid.uuid4().hex}"
    fs, where = _hadoop(spark, path)
    fs.deleteOnExit(where)
    return path


#: Bytes of a record batch on its way to a Python worker.
BATCH_BYTES = 8 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again. Its shuffle files go at once,
    and Python workers get batches of bounded size."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    with option(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), option(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables from written() that no later frame reads."""
    for table in tables:
        fs, where = _hadoop(table.sparkSession, table._scratch)
        fs.delete(where, True)


@contextmanager
def option(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session option for the actions inside, as it was before afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def fresh(taken: list[str], base: str) -> str:
    """A column name that clashes with none of ``taken`` (Spark compares without case)."""
    used = {c.lower() for c in taken}
    name = base
    while name.lower() in used:
        name += "_"
    return name
