"""Every registered query of the star schema against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from millrace import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _sorted(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = sql.execute(catalog.ORACLE_SQL[name])
    names = sorted(x[0] for x in want.description)
    assert sorted(got.columns) == names
    at = [[x[0] for x in want.description].index(n) for n in names]
    assert _sorted(tuple(r[n] for n in names) for r in got.collect()) == _sorted(tuple(r[i] for i in at) for r in want.fetchall())
