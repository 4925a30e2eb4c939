"""Every query with SQL against DuckDB on the smallest tables; the others by their rows."""

import os

import duckdb
import pytest

import __spark_entry__
from lumenscribe.plans import registry
from tests.conftest import TESTDATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(TESTDATA):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{TESTDATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return plain(tuple(v.values())) if isinstance(v, dict) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in found)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, TESTDATA)
    cursor = duck.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(columns, cursor.fetchall())
    assert got == want and got


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and len(found) >= 50


def test_rendered_queries_have_a_row_for_each_request(spark):
    for name, table in (("render_distorted", "supplier"), ("background_noise", "customer")):
        assert registry.QUERIES[name](spark, TESTDATA).count() == spark.read.parquet(f"{TESTDATA}/{table}.parquet").count()
