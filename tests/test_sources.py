from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyfold.functions.dates import days, month
from tallyfold.plans import grouped_questions as grouped
from tallyfold.plans import simple_questions as simple
from tallyfold.session import cluster_settings, shared_folder
from tallyfold.sources import items as files
from tallyfold.sources.dump import SCHEMAS, TABLES, CuratedTables, DumpTables, curate, store_bucketed
from tallyfold.sources.tables import schema_inventory, schema_subset, table_counts


def columns(name):
    return [part.split(" ")[0] for part in SCHEMAS[name].split(", ")]


@pytest.fixture(scope="module")
def exported(spark, tables, tmp_path_factory):
    """An export of the business tables, opened as it is and after curation."""
    root = str(tmp_path_factory.mktemp("export"))
    for name in TABLES:
        tables.table(name).select(*columns(name)).write.parquet(f"{root}/dump/{name}")
    dump = DumpTables(spark, f"{root}/dump")
    curate(dump, f"{root}/curated")
    return dump, CuratedTables(spark, f"{root}/curated")


@pytest.mark.parametrize("question", [
    grouped.top_cities_in_month, grouped.top_categories_by_sales, grouped.top_refunded_top_categories,
    grouped.active_day_runs, grouped.top_products_by_gmv, grouped.ordered_never_paid, grouped.monthly_growth,
    grouped.payments_by_method_two_months, grouped.refund_rate, simple.order_volume, simple.channel_users,
], ids=lambda f: f.__name__)
def test_questions_agree_on_every_source(tables, exported, question):
    wanted = sorted(map(tuple, question(tables).collect()), key=repr)
    for source in exported:
        assert sorted(map(tuple, question(source).collect()), key=repr) == wanted


def test_curation_loses_no_row(tables, exported):
    for name in TABLES:
        assert exported[1].table(name).count() == tables.table(name).count()


def test_curated_range_prunes_months(exported):
    plan = exported[1].table("orders", month("1996-03"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(created_ts" in plan
    plan = exported[1].table("daily_user_activity", days("2024-01-02", "2024-01-03"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day" in plan


def test_unreadable_time_is_kept(spark, make, scratch):
    make("id bigint, user_id bigint, status string, total_amount double, created_at string, pay_time string",
         [(1, 1, "paid", 5.0, "2025/03/05 12:00", None), (2, 1, "paid", 5.0, "rubbish", None)]).write.parquet(f"{scratch}/d/orders")
    curate(DumpTables(spark, f"{scratch}/d"), f"{scratch}/c", ("orders",))
    stored = CuratedTables(spark, f"{scratch}/c")
    assert stored.table("orders").count() == 2
    assert [row["id"] for row in stored.table("orders", month("2025-03")).collect()] == [1]


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_text_exports(spark, make, scratch, kind):
    frame = make("id bigint, name string, parent_id bigint", [(1, "数码, \"A\"", None), (2, "x", 1)])
    writer = frame.write.option("header", True).option("escape", '"')
    writer.csv(f"{scratch}/categories") if kind == "csv" else frame.write.json(f"{scratch}/categories")
    found = DumpTables(spark, scratch, kind).table("categories").orderBy("id").collect()
    assert [(row["id"], row["parent_id"]) for row in found] == [(1, None), (2, 1)]


def test_items_skip_blank_lines_and_stop_at_bad_ones(spark, scratch):
    with open(f"{scratch}/items.jsonl", "w", encoding="utf-8") as file:
        file.write('{"id": 1, "question": "多少单？", "gold_sql": "SELECT 1", "difficulty": "easy", "tags": ["a", "b"]}\n\n')
    rows = files.read_jsonl(spark, f"{scratch}/items.jsonl").collect()
    assert [(row["id"], row["question"], row["tags"]) for row in rows] == [(1, "多少单？", ["a", "b"])]
    with open(f"{scratch}/bad.jsonl", "w", encoding="utf-8") as file:
        file.write('{"id": 1, "question"\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_jsonl(spark, f"{scratch}/bad.jsonl").collect()


def test_report_keeps_quotes_commas_and_lines(spark, make, scratch):
    frame = make("qid int, reason string, tags array<string>", [(1, 'a "b", c\nd', ["x", "y"]), (2, None, [])])
    path = files.write_report_csv(frame, f"{scratch}/report")
    back = files.read_report_csv(spark, path, "qid int, reason string, tags string").orderBy("qid").collect()
    assert [tuple(row) for row in back] == [(1, 'a "b", c\nd', '["x","y"]'), (2, None, "[]")]


def test_subset_falls_back_to_all(spark, tables):
    inventory = schema_inventory(spark, {"users": tables.table("users"), "orders": tables.table("orders")})
    everything = inventory.count()
    assert schema_subset(inventory, []).count() == everything
    assert schema_subset(inventory, ["nope"]).count() == everything
    assert schema_subset(inventory, ["users", "orders"]).count() == everything
    assert schema_subset(inventory, ["users"]).select("table").distinct().collect() == [("users",)]


def test_counts_cover_empty_tables(spark):
    found = table_counts({"some": spark.range(3), "none": spark.range(0)}).collect()
    assert sorted(map(tuple, found)) == [("none", 0), ("some", 3)]


def test_every_kind_of_dirt_is_in_the_tables(tables):
    orders, reviews = tables.table("orders"), tables.table("reviews")
    assert orders.select(F.count_distinct("status") - F.count_distinct(F.lower("status"))).first()[0] > 0
    for condition in ("total_amount IS NULL", "total_amount < 0", "created_at LIKE '%+08:00'", "created_at LIKE '____/%'", "created_at LIKE '%T%'"):
        assert orders.where(condition).limit(1).count() == 1
    assert reviews.where("rating NOT BETWEEN 1 AND 5").limit(1).count() == 1


def test_bucketed_tables_join_without_a_shuffle(spark, tables, scratch):
    store_bucketed(tables.table("orders").withColumnRenamed("id", "order_id"), "orders_by_order", "order_id", 4, f"{scratch}/o")
    store_bucketed(tables.table("order_items"), "items_by_order", "order_id", 4, f"{scratch}/i")
    try:
        joined = spark.table("items_by_order").hint("merge").join(spark.table("orders_by_order"), "order_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == tables.table("order_items").join(
            tables.table("orders").withColumnRenamed("id", "order_id"), "order_id").count()
    finally:
        spark.sql("DROP TABLE orders_by_order")
        spark.sql("DROP TABLE items_by_order")


def test_settings_grow_with_the_input():
    small, large = cluster_settings(10**9), cluster_settings(100 * 1024**4)
    assert small["spark.sql.shuffle.partitions"] == "200" and large["spark.sql.shuffle.partitions"] == "100000"
    assert cluster_settings(10 * 1024**4)["spark.sql.shuffle.partitions"] == "81920"


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Elsewhere()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Session())
