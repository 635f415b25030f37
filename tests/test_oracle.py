"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

ORACLE = entry.archive.ORACLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if pd.isna(v) else "%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["device_id", "seq", "ts", "id", "table", "body"]
