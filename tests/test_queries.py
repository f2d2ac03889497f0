"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(ORACLES[name])
    assert mine == rows_of([c[0] for c in result.description], result.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["accepted_filter"](spark, SF))
    assert "o_orderdate" not in plan and "l_shipdate" not in plan


@pytest.mark.parametrize(
    "name", ["gate_stats_by_safety_factor", "edge_features", "tet10_strain", "bases_by_safety_factor", "assign_splits"]
)
def test_no_cartesian_or_estimated_broadcast(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BroadcastHashJoin" not in plan
