"""Every query that has SQL gives DuckDB's rows; the others give rows at all."""

import glob
import os

import duckdb
import pytest

from seriesloom.plans import catalog

SLOW = {"hpo_fleetwide", "arima_plus_udf", "sarimax_udf", "ucm_udf"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == cols
    rows = sorted((tuple(dict(zip(want.columns, r, strict=True))[c] for c in cols) for r in want.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == rows


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - SLOW))
def test_gives_rows(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(catalog.SQL) <= set(__spark_entry__.oracle_sql())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalog.panel_daily(spark, sf)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "l_extendedprice" not in scan and "l_quantity" in scan
