"""Every registered query with an SQL twin must give the twin's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    state, n, _, note = compare(spark, con, SF, key, QUERIES[key], ORACLES.get(key))
    assert state in ("ok", "rows-only"), (state, n, note)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
