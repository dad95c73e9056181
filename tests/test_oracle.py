"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tesserae.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def rows(df):
    df = df[sorted(df.columns)]
    cell = lambda v: None if pd.isna(v) else round(float(v), 5) + 0.0 if isinstance(v, float) else v
    return sorted(repr([cell(v.item() if hasattr(v, "item") else v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = registry.queries()[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 100
