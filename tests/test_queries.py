"""Every registered query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from textloom.plans import learned, registry, reports

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql() | reports.oracle_sql() | learned.oracle_sql()
QUERIES = registry.queries() | reports.queries() | learned.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def ordered(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str) if s.dtype == object else s).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = ordered(QUERIES[name](spark, DATA).toPandas()), ordered(duck.execute(SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
