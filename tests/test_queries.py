"""Every registered query against the same question in SQL on the same tables."""

import math
import os
from pathlib import Path

import pytest

from stratiform.plans import all_queries

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REGISTRY = all_queries()

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables are absent")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def ordered(names, rows):
    """Columns by name, rows in a fixed order, NaN as null."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [
        tuple(None if isinstance(row[i], float) and math.isnan(row[i]) else row[i] for i in order) for row in rows
    ]
    return sorted(names), sorted(plain, key=lambda row: tuple((v is None, str(type(v)), "" if v is None else v) for v in row))


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, sql, name):
    frame = REGISTRY.QUERIES[name](spark, FOLDER)
    rows = [tuple(row) for row in frame.collect()]
    if name not in REGISTRY.SQL:
        assert rows
        return
    answer = sql.execute(REGISTRY.SQL[name])
    expected = ordered([column[0] for column in answer.description], answer.fetchall())
    got = ordered(frame.columns, rows)
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]


def test_only_fits_lack_sql():
    assert set(REGISTRY.QUERIES) - set(REGISTRY.SQL) == {"explore_logit", "explore_regress_many"}
