"""Queries of the training text operators against their SQL, and what both lists hold."""

import pytest

from geolens.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    expected = duck.sql(ORACLES[name])
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(expected.columns, expected.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
