"""Every registered query beside its SQL on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import rows_of
from zonomy.plans import QUERIES
from zonomy.plans.base import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


# the recursive reachability of these texts grows with the square of the large gaps of the sparse smallest scale
SLOW_SQL = {"repair_seams"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    assert len(set(df.columns)) == len(df.columns)
    if sql is None or name in SLOW_SQL:
        assert got
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_key_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
