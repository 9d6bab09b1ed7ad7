"""Every registered query against its SQL on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = Path("/root/testdata/sf0.001")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]
QUERIES, CHECKS = entry_points.queries(), entry_points.oracle_sql()
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def in_order(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in places) for row in rows), key=repr)


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    result = QUERIES[name](spark, str(FOLDER))
    rows = result.collect()
    if name not in CHECKS:
        assert rows
        return
    checked = tables.execute(CHECKS[name])
    columns = [c[0] for c in checked.description]
    assert sorted(result.columns) == sorted(columns)
    assert in_order(result.columns, rows) == in_order(columns, checked.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
