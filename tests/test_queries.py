"""Every query with SQL against DuckDB on the small tables; the stream against the batch."""

import glob
import os

import duckdb
import pytest

from quarry.plans import queries as q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM '{t}'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple("" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = rows(q.QUERIES[name](spark, DIR).toPandas()), rows(duck.sql(q.ORACLE_SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_query_runs(spark):
    for name in set(q.QUERIES) - set(q.ORACLE_SQL):
        assert q.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
