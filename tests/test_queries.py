"""Every named query against its SQL in DuckDB at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in os.listdir(SF):
        c.sql(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    return c


def _cells(rows, columns):
    show = lambda v: repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in got.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    want = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _cells(rows, columns) == _cells([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
