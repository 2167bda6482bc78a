"""Every registered query against its oracle SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry
from geolens.plans.catalog import all_oracles, all_queries
from geolens.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name in ROWS_ONLY:
        assert got[1]
        return
    expected = duck.sql(ORACLES[name])
    assert got == rows_of(expected.columns, expected.fetchall())


def test_only_known_queries_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


def test_entry(spark):
    assert entry(spark).count() == 1
