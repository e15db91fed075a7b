"""Every registered query against its DuckDB text on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
OWN = entry._all()
QUERIES = {name: run for name, (run, _) in OWN.items()}
TEXTS = {name: text for name, (_, text) in OWN.items()}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, v if v is not None else 0) for v in row])


def test_every_query_has_a_text():
    assert all(TEXTS.values())
    assert QUERIES.keys() <= entry.queries().keys() and TEXTS.keys() <= entry.oracle_sql().keys()


# Their order is part of the result; m2 to m6 and the other queries are sets of rows.
IN_ORDER = re.compile(r"[ac]\d+_")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    names = sorted(frame.columns)
    result = duck.sql(TEXTS[name])
    assert sorted(result.columns) == names
    places = [result.columns.index(n) for n in names]
    expected = [tuple(plain(row[i]) for i in places) for row in result.fetchall()]
    found = [tuple(plain(row[n]) for n in names) for row in frame.collect()]
    if not IN_ORDER.match(name):
        expected, found = ordered(expected), ordered(found)
    assert found == expected


def test_flagship(spark):
    assert [r["abc_class"] for r in entry.entry(spark).collect()] == ["A", "B", "C"]
