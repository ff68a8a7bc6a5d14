"""The driver's contract, and every query with SQL against DuckDB at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabulon import catalog, catalog_io, catalog_more

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() == 3


NAMES = sorted((catalog.SQL.keys() | catalog_io.SQL.keys() | catalog_more.SQL.keys()))


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    q = entry.queries()[name](spark, SF)
    columns = sorted(q.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    key = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    got = [tuple(r) for r in q.select(*[f"`{c}`" for c in columns]).collect()]
    assert key(got) == key(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_every_query_has_a_callable():
    assert all(callable(f) for f in entry.queries().values()) and set(entry.oracle_sql()) <= set(entry.queries())
