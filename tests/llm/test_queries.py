"""The operators' queries with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tesserae.llm import queries
from tests.test_oracle import SF

SQL = queries.oracle_sql()


def rows(df):
    """Rows to compare, whole numbers as such also in columns with nulls."""
    cell = lambda v: None if pd.isna(v) else int(v) if not isinstance(v, str) and v == int(v) else round(float(v), 5) if isinstance(v, float) else v
    return sorted(repr([cell(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
