"""Every grid query against its SQL on the smallest tables, and the shape of the plans that matter."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sphereframe.operators import moc
from sphereframe.plans import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return con


def _norm(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, db, name):
    df, rel = Q.QUERIES[name](spark, DATA), db.sql(Q.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted((_norm(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((_norm(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(entry.queries())


def test_region_filter_is_an_equi_join(spark):
    plan = Q.QUERIES["grid_region_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    plan = moc.overlap(moc.intervals(Q._dense(spark, DATA)), moc.intervals(Q._dense_b(spark, DATA)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_shard_records_sort_no_rows_and_repeat_none(spark):
    plan = Q._stats(spark, DATA, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
    plan = Q._stats(spark, DATA, 3)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") <= 2  # of what is left of a shard
