"""Every query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("SQL_SF_DIR", "/root/testdata/sf0.001")


def rounded(x):
    return round(x, 5) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(rounded(r[c]) for c in columns) for r in got.collect()) == key(tuple(map(rounded, r)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
