"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from evalweave.checks.fixtures import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(row[c]) for c in columns) for row in df.collect())
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    places = [found.index(c) for c in columns]
    assert rows == sorted(tuple(shown(r[i]) for i in places) for r in result.fetchall())


def test_flagship(spark):
    board = entry.entry(spark)
    ranks = [r["rank"] for r in board.collect()]
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
