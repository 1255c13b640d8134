"""The registered queries against their SQL on the smallest tables."""

import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, Decimal):
        return format(value.normalize(), "f")
    return value.isoformat() if hasattr(value, "isoformat") else repr(value)


@pytest.fixture(scope="module")
def tables():
    if not Path(FOLDER).is_dir():
        pytest.skip("the test tables aren't here")
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in Path(FOLDER).iterdir():
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    rows = sorted(tuple(map(plain, r)) for r in found.select(*columns).collect())
    if name in ORACLES:
        answer = tables.execute(ORACLES[name])
        names = [d[0] for d in answer.description]
        assert sorted(names) == columns
        assert sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()) == rows


def test_entry_and_names(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert {f"p{n}_found" for n in range(1, 7)} <= set(QUERIES)
    if Path("/root/testdata/sf0.001").is_dir():
        assert __spark_entry__.entry(spark).count() > 0
