import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
FAST = sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _rows(rows):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_as_sql(spark, con, name):
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.select(*want.columns).collect()) == _rows(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_time_range_reaches_the_scan(spark):
    plan = QUERIES["time_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan
