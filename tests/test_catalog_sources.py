"""Queries that write and read, and those of the remaining operators, against DuckDB."""

import pytest

from millrace import catalog, catalog_sources
from tests.test_catalog import FOLDER, _sorted, pytestmark, sql  # noqa: F401

NAMES = sorted(n for n in catalog.QUERIES if n.startswith("io_") or hasattr(catalog_sources, n) and getattr(catalog_sources, n).__module__ == "millrace.catalog_sources")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):  # noqa: F811
    got = catalog.QUERIES[name](spark, FOLDER)
    want = sql.execute(catalog.ORACLE_SQL[name])
    names = sorted(x[0] for x in want.description)
    assert sorted(got.columns) == names
    at = [[x[0] for x in want.description].index(n) for n in names]
    assert _sorted(tuple(r[n] for n in names) for r in got.collect()) == _sorted(tuple(r[i] for i in at) for r in want.fetchall())
