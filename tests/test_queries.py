"""Every query with SQL gives the rows that DuckDB gives; every scan reads what it needs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from relweave import queries as core


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", core.queries())
def test_same_rows(name, spark, sf, con):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted(repr([r[c] for c in columns]) for r in df.collect())
    made = con.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in made.description]
    assert sorted(theirs) == columns
    assert found == sorted(repr([r[theirs.index(c)] for c in columns]) for r in made.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["segment", "n_orders", "total"]


def test_pushdown(spark, sf):
    plan = entry.queries()["where_comparisons"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_mktsegment)" in plan and "c_acctbal" in plan
    read = entry.queries()["flagship"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in read


@pytest.mark.parametrize("name", ["join_left_on", "join_left_leaf", "join_left_path", "select_tuple", "select_merge", "group_by_primary_key", "left_join_top_n", "preload_separate", "preload_separate_scoped"])
def test_whole_tables(name, spark, sf, con):
    """These queries give every customer."""
    df = entry.queries()[name](spark, sf)
    key = next(c for c in ("c_custkey", "key", "_1") if c in df.columns)
    assert df.select(key).distinct().count() == con.execute("SELECT count(*) FROM customer").fetchone()[0]


@pytest.mark.parametrize("name", ["where_not_in_or", "where_not_in_subquery", "join_left_on_not_in"])
def test_not_in_plans(name, spark, sf):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_preload_reads_loaded_children(spark, sf):
    from relweave.sources.catalog import catalog

    q = catalog(sf).query("customer").where(("c_nationkey", 1)).preload_separate("orders")
    plan = q.to_df(spark)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    whole = catalog(sf).query("customer").preload_separate("orders").to_df(spark)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" not in whole
