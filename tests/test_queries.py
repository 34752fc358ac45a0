"""Every query beside its SQL, on the smallest data set."""

import glob
import os

import pytest

import __spark_entry__ as entry
from tools.verify import rows

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert rows(df.columns, got) == rows([c[0] for c in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
