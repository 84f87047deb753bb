"""Every chat query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from dialoom.plans import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(oracle.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_no_python_in_native_plans(spark):
    plan = queries.qa_dialogues(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_telegram(spark):
    assert queries.telegram_parse(spark, SF).count() > 0
