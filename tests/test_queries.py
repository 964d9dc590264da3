"""Each query with SQL against DuckDB on the smallest tables; the others give rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from driftpath.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    rows = QUERIES[name](spark, SF)
    cols = sorted(rows.columns)
    got = sorted(map(tuple, rows.select(*cols).collect()), key=str)
    if name in SQL:
        want = db.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
        assert got == sorted(want, key=str)
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
