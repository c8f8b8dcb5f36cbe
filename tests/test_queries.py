"""Every registered query against its independent SQL, on whole tables, and the shape of its plan."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as contract
from tallyfold.plans import catalog
from tallyfold.sources.mapped import BASE_TABLES

SMALL = "/root/testdata/sf0.001"
NAMES = catalog.names()
QUERIES, SQL = ({name: found[name] for name in NAMES} for found in (contract.queries(), contract.oracle_sql()))


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, list | tuple):
        return tuple(plain(item) for item in value)
    return value


def in_order(columns, rows):
    order = sorted(columns)
    return sorted((tuple(plain(row[columns.index(name)]) for name in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, oracle, name):
    frame = QUERIES[name](spark, SMALL)
    cursor = oracle.execute(SQL[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert in_order(frame.columns, [tuple(row) for row in frame.collect()]) == in_order(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_cross_product(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan, f"{operator} in the plan of {name}"


def test_every_query_has_sql():
    assert set(NAMES) <= set(contract.oracle_sql())


def test_entry_returns_rows(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["city", "cnt"]
    assert len(frame.collect()) == 5


@pytest.mark.parametrize("name, column", [
    ("top_cities_in_month", "o_orderdate"), ("orders_per_day", "o_orderdate"), ("top_categories_by_sales", "o_orderdate"),
    ("top_products_by_gmv", "l_shipdate"), ("refunds_per_day", "l_shipdate"), ("f_prefix", "l_shipdate"),
    ("channel_users", "ts"), ("active_day_runs", "ts"),
])
def test_month_filter_reaches_the_scan(spark, name, column):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual({column}" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["p_min_fields"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan


@pytest.fixture
def no_broadcast(spark):
    """Joins as they run when every side is large, with skewed partitions split at the slightest sign."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", [
    "top_categories_by_sales", "top_sellers_by_refund_rate", "top_refunded_top_categories", "city_ranks", "j_star5",
    "j_anti_not_in", "j_anti_not_in_null", "j_scalar_eq", "ordered_never_paid", "cities_without_orders", "cities_without_orders_in_days",
    "dq_price_outlier", "dq_orphans", "cmp_first_mismatch", "m_latency", "m_ablation",
])
def test_large_sides_give_the_same_rows(spark, oracle, no_broadcast, name):
    frame = QUERIES[name](spark, SMALL)
    cursor = oracle.execute(SQL[name])
    columns = [column[0] for column in cursor.description]
    assert in_order(frame.columns, [tuple(row) for row in frame.collect()]) == in_order(columns, cursor.fetchall())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
