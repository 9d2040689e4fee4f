"""Every query has a plan, and those with SQL agree with it on small tables."""

import duckdb
import pytest

import __spark_entry__ as registered
from quarrylog import catalogue

TABLES = "region nation customer supplier part orders lineitem events".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return made


def test_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) <= set(registered.queries())
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).columns == ["a", "b"]


@pytest.mark.parametrize("name", catalogue.queries())
def test_agrees_with_sql(spark, con, name):
    df = catalogue.queries()[name](spark, SMALL)
    expected = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, expected.fetchall()))
