"""Registered queries against their SQL twins on the smallest tables; none may plan a cross product."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="needs the shared test tables")


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: float(f"{v:.12g}") if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, engine, name):
    df = entry.queries()[name](spark, str(SF_DIR))
    rows = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = engine.sql(sql)
    assert sorted(result.columns) == sorted(df.columns)
    assert comparable(rows, df.columns) == comparable(result.fetchall(), result.columns)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
