"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = db.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plans_stay_native(spark):
    """Searches, sorts and lookups keep to codegen; a top-k page doesn't sort the table."""
    plan = lambda name: entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for name in ("search_page_orders", "mixed_sort_asc", "lookup_left", "interval_lookup", "line_log", "csv_rows"):
        assert "Python" not in plan(name) and "Arrow" not in plan(name), name
    assert "TakeOrderedAndProject" in plan("top_page")
    assert "CartesianProduct" not in plan("theta_suffix_join") and "BroadcastNestedLoopJoin" not in plan("theta_suffix_join")
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan("row_range")
