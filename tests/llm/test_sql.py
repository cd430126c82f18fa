"""Queries that SQL can express give DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from seriesloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(name, spark, sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = c.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    rows = sorted((tuple(dict(zip(want.columns, r))[k] for k in cols) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[k] for k in cols) for r in df.collect()), key=repr) == rows
