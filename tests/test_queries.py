"""Registered queries against the same SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from pointloom.plans import registry

from .conftest import DATA

NAMES = sorted(registry.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def shown(value) -> str:
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = df.collect()
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    want = sorted(tuple(shown(row[columns.index(c)]) for c in names) for row in found.fetchall())
    assert sorted(tuple(shown(row[c]) for c in names) for row in got) == want
    assert want


def test_every_query_has_a_name_of_its_own():
    assert registry.FLAGSHIP in registry.QUERIES
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
