"""Every registered query runs; those with an SQL counterpart return the same rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    _, rows, verdict = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert verdict in ("equal", "rows only")
    assert rows > 0 or name in entry.oracle_sql()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["shot_id", "rank", "score"] and df.count() == 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
