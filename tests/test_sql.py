"""Every query that has SQL gives the rows that DuckDB gives over the same tables."""

import math
import os
from pathlib import Path

import pytest

from cardweave.plans.queries import QUERIES, SQL

FOLDER = Path(os.environ.get("SQL_SF_DIR", "/root/testdata/sf0.001"))


def plain(x):
    """Values that both engines' clients give alike: arrays and maps as lists, NaN as a word, whole floats as they are."""
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, dict):
        return sorted((k, plain(v)) for k, v in x.items())
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not FOLDER.exists():
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_those_of_sql(spark, duck, name):
    got = QUERIES[name](spark, str(FOLDER))
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    left, right = rows_of(got.columns, got.collect()), rows_of(columns, want.fetchall())
    assert len(left) == len(right)
    assert left == right
