"""Every registered query against its SQL in DuckDB at the smallest scale, and plan checks.

Plans are checked at every job of a query, so also inside tables that it writes on its way.
"""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import DataFrameWriter

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture()
def plans(monkeypatch):
    """Physical plans of all frames that are written while a query is built."""
    seen = []
    real = DataFrameWriter.parquet

    def parquet(self, *args, **options):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return real(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return seen


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, plans, name):
    df = QUERIES[name](spark, SF)
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert not [w for p in plans for w in FORBIDDEN if w in p]
    got = rows_of(df.columns, df.collect())
    if name in SQL:
        cur = con.execute(SQL[name])
        assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
    else:
        assert got[0]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["seed", "via", "target", "confidence"] and df.count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    from ripplegraph.plans import graph_view as g

    rel = g.relationships(spark, SF, ["located_in"]).filter("confidence > 0.5").select("from_id")
    plan = rel._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*relation#\d+ = located_in", plan)
    assert "GreaterThan(confidence,0.5)" in plan and "ReadSchema: struct<from_id:string,confidence:double>" in plan
