"""Comparison of a query with its SQL over the same Parquet files, by DuckDB."""

import glob
import os

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(_plain, v)) if isinstance(v, list) else v


def assert_same(spark, query, sql, sf_dir=SMALL):
    if not os.path.isdir(sf_dir):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted((tuple(_plain(r[c]) for c in sorted(names)) for r in rows), key=repr)
    assert key(df.collect()) == key(want)
