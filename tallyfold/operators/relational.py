"""Join, rollup and top-n shapes that retail questions keep using, arranged for very large facts.

Two rules run through all of them. A fact is reduced by its foreign key before it meets another
table: the partial aggregate runs on the map side, so a key that owns a third of all rows crosses the
shuffle as a handful of rows. And no broadcast is forced: Spark picks one itself when a side is below
``spark.sql.autoBroadcastJoinThreshold`` by statistics or by measured size at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def sums_by(df: DataFrame, *keys: str, **measures: Column | str) -> DataFrame:
    """Sums per key of columns or SQL expressions; the expression ``"1"`` counts rows."""
    values = {name: F.expr(value) if isinstance(value, str) else value for name, value in measures.items()}
    return df.groupBy(*keys).agg(*(F.sum(value).alias(name) for name, value in values.items()))


def roll_up(
    facts: DataFrame, key: str, dimension: DataFrame, by: list[str], dimension_key: str = "id", **measures: Column | str
) -> DataFrame:
    """Sum measures of a fact by attributes of the dimension its key points to (inner join)."""
    per_key = sums_by(facts, key, **measures)
    joined = per_key.join(dimension.select(F.col(dimension_key).alias(key), *by), key)
    return sums_by(joined, *by, **{name: F.col(name) for name in measures})


def top_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """First n rows in a total order. Each task keeps n rows, so nothing is sorted as a whole."""
    return df.orderBy(*order).limit(n)


def without_match(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Rows of ``left`` whose key is absent on the right (NOT EXISTS).

    The right side is reduced to its distinct keys first, which bounds what a hot key can send.
    """
    keys = right.select(F.col(right_key).alias(left_key)).distinct()
    return left.join(keys, left_key, "left_anti")


def not_in(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """SQL ``NOT IN`` with its NULL rules, without the broadcast a null-aware anti join needs.

    One NULL on the right leaves nothing; a NULL on the left survives only against an empty right.
    """
    about_right = right.agg(F.struct(F.count("*").alias("all"), F.count(right_key).alias("known"))).scalar()
    kept = without_match(left.where(F.col(left_key).isNotNull()), left_key, right, right_key)
    null_rows = left.where(F.col(left_key).isNull()).where(about_right["all"] == 0)
    return kept.where(about_right["all"] == about_right["known"]).unionByName(null_rows)


def category_paths(categories: DataFrame) -> DataFrame:
    """Second-level categories with their parent: ``category_id, category, top_id, top``."""
    child = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"), "parent_id")
    parent = categories.select(F.col("id").alias("top_id"), F.col("name").alias("top"))
    return child.join(parent, child["parent_id"] == parent["top_id"]).drop("parent_id")


def rows_at_maximum(df: DataFrame, value: str) -> DataFrame:
    """Every row that holds the maximum of a column, ties included."""
    peak = df.agg(F.max(value).alias("peak"))
    return df.join(peak, df[value] == peak["peak"]).drop("peak")


def total_ratio(top: DataFrame, top_value: Column, bottom: DataFrame, bottom_value: Column, name: str) -> DataFrame:
    """Sum over one table divided by the sum over another, in one aggregate over their union."""
    both = top.select(top_value.alias("top"), F.lit(None).alias("bottom")).unionByName(
        bottom.select(F.lit(None).alias("top"), bottom_value.alias("bottom"))
    )
    quotient = F.try_divide(F.sum("top").cast("double"), F.sum("bottom").cast("double"))
    return both.agg(F.round(quotient, 6).alias(name))


def refunds_and_sales(items: DataFrame, refunds: DataFrame, amount: Column) -> DataFrame:
    """Refunded and sold amount per product, from two facts.

    Refunds collapse per order line, meet the lines once, and both sums come out of one aggregate.
    """
    per_item = sums_by(refunds, "order_item_id", refunded=F.col("amount"))
    lines = items.select(F.col("id").alias("order_item_id"), "product_id", amount.alias("sold"))
    joined = lines.join(per_item, "order_item_id", "left")
    return sums_by(joined, "product_id", sold=F.col("sold"), refunded=F.coalesce("refunded", F.lit(0)))


def refunded_by_product(items: DataFrame, refunds: DataFrame) -> DataFrame:
    """Refunded amount per product, only products that have one."""
    per_item = sums_by(refunds, "order_item_id", refunded=F.col("amount"))
    joined = items.select(F.col("id").alias("order_item_id"), "product_id").join(per_item, "order_item_id")
    return sums_by(joined, "product_id", refunded=F.col("refunded"))


def lines_of(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines that belong to the given orders.

    The lines go into the join as they are: grouping them by order and product first would shuffle
    them twice and merge hardly any. An order that owns a large part of all lines is split by the
    run-time skew handling, because the next step groups by another key.
    """
    return items.join(orders.select(F.col("id").alias("order_id")), "order_id")
