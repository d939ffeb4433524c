"""Every query that SQL can express, against DuckDB on the small tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float).round(6)
        df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    ours = canonical(entry.queries()[name](spark, DATA).toPandas())
    theirs = canonical(duck.execute(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"))
def test_runs(spark, name):
    found = entry.queries()[name](spark, DATA)
    assert found.columns and found.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
