"""Every registered query with SQL gives what DuckDB gives on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import canon

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        out.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return out


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    order = [names.index(c) for c in columns]
    want = sorted(tuple(canon(r[i]) for i in order) for r in cursor.fetchall())
    assert sorted(tuple(canon(r[c]) for c in columns) for r in df.collect()) == want


def test_entry_has_a_stable_schema(spark):
    if os.path.isdir(FOLDER):
        assert entry.entry(spark).columns == ["attribute", "event_id", "version_id"]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
