"""Exported business tables: open them as they are, or store them once with typed, prunable time.

An export has one folder or file per table (Parquet, CSV with header, or JSON lines) with the columns
of ``SCHEMAS``. ``DumpTables`` parses text timestamps while reading. ``curate`` does it once and
partitions facts by month, after which ``CuratedTables`` prunes months and row groups by range.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.dates import Days, parse_stamp

# The fourteen tables, their columns and types, and what each is about.
MONEY = "decimal(18,4)"
SCHEMAS = {
    "users": "id bigint, username string, email string, city string, register_date string, vip_level int, is_deleted int",
    "addresses": "id bigint, user_id bigint, province string, city string, detail string, is_default int",
    "categories": "id bigint, name string, parent_id bigint",
    "sellers": "id bigint, name string, city string, rating double, open_date string",
    "products": (
        f"id bigint, name string, category_id bigint, seller_id bigint, price {MONEY}, cost {MONEY}, stock int, "
        "status string, created_at string"
    ),
    "orders": f"id bigint, user_id bigint, status string, total_amount {MONEY}, created_at string, pay_time string",
    "order_items": (
        f"id bigint, order_id bigint, product_id bigint, seller_id bigint, quantity int, unit_price {MONEY}, "
        f"discount {MONEY}"
    ),
    "payments": f"id bigint, order_id bigint, method string, amount {MONEY}, paid_at string, status string",
    "refunds": f"id bigint, order_item_id bigint, amount {MONEY}, reason string, refunded_at string",
    "reviews": "id bigint, product_id bigint, user_id bigint, rating int, content string, created_at string",
    "coupons": (
        f"id bigint, name string, discount_type string, value {MONEY}, min_amount {MONEY}, start_date string, "
        "end_date string"
    ),
    "user_coupons": "id bigint, user_id bigint, coupon_id bigint, used int, used_at string",
    "daily_product_metrics": (
        f"date string, product_id bigint, pv bigint, uv bigint, cart_adds bigint, orders bigint, gmv {MONEY}, "
        f"refund_amount {MONEY}, search_impressions bigint, search_clicks bigint, stock_out_hours double, avg_price {MONEY}"
    ),
    "daily_user_activity": (
        f"date string, user_id bigint, sessions bigint, page_views bigint, duration_sec bigint, orders bigint, "
        f"amount {MONEY}, device string, os string, app_version string, channel string"
    ),
}

# Typed column of each fact and the text it comes from.
TYPED_TIME = {
    "orders": ("created_ts", "created_at"),
    "payments": ("paid_ts", "paid_at"),
    "refunds": ("refunded_ts", "refunded_at"),
    "reviews": ("created_ts", "created_at"),
    "user_coupons": ("used_ts", "used_at"),
    "daily_product_metrics": ("day", "date"),
    "daily_user_activity": ("day", "date"),
}
TABLES = tuple(SCHEMAS)
MONTH = "month"


def typed(name: str, df: DataFrame) -> DataFrame:
    """Add the typed time of a fact: a day for the per-day tables, else a timestamp."""
    if name not in TYPED_TIME:
        return df
    moment, text = TYPED_TIME[name]
    return df.withColumn(moment, F.col(text).try_cast("date") if moment == "day" else parse_stamp(F.col(text)))


def falls_into(name: str, during: Days) -> Column:
    moment = TYPED_TIME[name][0]
    return during.holds(F.col(moment), "date" if moment == "day" else "timestamp_ntz")


class DumpTables:
    """Business tables of one export, with typed time computed on the fly."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def raw(self, name: str) -> DataFrame:
        """The stored columns; numbers of a Parquet export are brought to their declared types."""
        location = f"{self.path}/{name}"
        if self.kind == "parquet":
            stored = self.spark.read.parquet(location)
            kinds = dict(stored.dtypes)
            wanted = [part.split(" ") for part in SCHEMAS[name].split(", ")]
            return stored.select(*(
                F.col(column) if kinds[column] == "string" else F.col(column).cast(kind).alias(column)
                for column, kind in wanted
            ))
        reader = self.spark.read.schema(SCHEMAS[name]).option("mode", "FAILFAST")
        return reader.option("header", True).csv(location) if self.kind == "csv" else reader.json(location)

    def table(self, name: str, during: Days | None = None) -> DataFrame:
        df = typed(name, self.raw(name))
        return df if during is None else df.where(falls_into(name, during))

    def register(self) -> None:
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)


def month_of(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def curate(tables, out: str, names: tuple[str, ...] = TABLES) -> None:
    """Store tables with typed time, facts partitioned by month.

    ``rebalance`` gathers the rows of a month for few, large files and splits a month that is much
    larger than the others over several tasks. Rows whose time cannot be read keep a partition of
    their own; none is dropped.
    """
    for name in names:
        df = tables.table(name)
        target = f"{out.rstrip('/')}/{name}"
        if name not in TYPED_TIME:
            df.write.parquet(target)
            continue
        by_month = df.withColumn(MONTH, month_of(F.col(TYPED_TIME[name][0])))
        by_month.hint("rebalance", F.col(MONTH)).write.partitionBy(MONTH).parquet(target)


def store_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Store a table bucketed by a join key in the session's catalog.

    Two tables with the same number of buckets join on that key without a shuffle: worth it for keys
    many queries join on, such as the order of an order line. Hashing the rows to their buckets first
    makes one file per bucket instead of one per bucket and task. A bucket is never split, so a key with
    one value in a large part of all rows is better left to a plain join and its skew handling.
    """
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


class CuratedTables:
    """Business tables written by ``curate``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str, during: Days | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        if name not in TYPED_TIME:
            return df
        if during is not None:
            first, last = (day.strftime("%Y-%m") for day in (during.first, _day_before(during.until)))
            df = df.where(F.col(MONTH).cast("string").between(first, last) & falls_into(name, during))
        return df.drop(MONTH)

    def register(self) -> None:
        for name in TABLES:
            self.table(name).createOrReplaceTempView(name)


def _day_before(day: date) -> date:
    return day - timedelta(days=1)
