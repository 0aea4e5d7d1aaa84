"""Every registered query beside its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from loam.plans import registry

SF = "/root/testdata/sf0.001"
SLOW = {"report_pages"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value if value is None or isinstance(value, int) else str(value)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    if sql := registry.oracle_sql().get(name):
        found = duck.sql(sql)
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    else:
        assert rows


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
