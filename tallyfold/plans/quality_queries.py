"""Data-quality operators over the business tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.functions.dates import day_key, month_key
from tallyfold.operators import quality as dq
from tallyfold.operators.quantiles import fences
from tallyfold.plans.registry import query


@query("dq_parse_ts",
       """SELECT o_orderkey AS id, CAST(o_orderdate AS VARCHAR) AS created, false AS unparsed FROM orders
          UNION ALL SELECT -1 - o_orderkey, CAST(o_orderdate AS VARCHAR), false FROM orders WHERE o_orderkey % 500 = 0""")
def dq_parse_ts(t):
    """The parsed text must give back the clean column it was made from."""
    orders = dq.parse_stamps(t.table("orders").select("id", "created_at"), "created_at")
    return orders.select("id", F.col("created_at_ts").cast("string").alias("created"),
                         F.col("created_at_ts").isNull().alias("unparsed"))


@query("dq_day_key", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def dq_day_key(t):
    return t.table("payments").groupBy(day_key(F.col("paid_at")).alias("day")).agg(F.count("*").alias("n"))


@query("dq_month_key", "SELECT strftime(l_shipdate, '%Y-%m') AS mon, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def dq_month_key(t):
    return t.table("refunds").groupBy(month_key(F.col("refunded_at")).alias("mon")).agg(F.count("*").alias("n"))


@query("dq_ts_format_census",
       """SELECT CASE WHEN o_orderkey % 20 < 3 THEN 'slash' WHEN o_orderkey % 20 = 3 THEN 'iso_t' ELSE 'dash' END AS shape,
                 count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def dq_ts_format_census(t):
    return dq.stamp_census(t.table("payments"), "paid_at")


@query("dq_tz_suffix_count", "SELECT count(*) AS n FROM events WHERE event_type IN ('view', 'click') AND event_id % 47 = 0")
def dq_tz_suffix_count(t):
    return dq.offset_suffixes(t.table("reviews"), "created_at")


@query("dq_case_normalize", "SELECT id, lower(status) AS status FROM r_orders")
def dq_case_normalize(t):
    return dq.normalize_case(t.table("orders").select("id", "status"), "status")


_VARIANT_SQL = """SELECT '{column}' AS "column", count(DISTINCT {column}) AS n_distinct,
                  count(DISTINCT lower({column})) AS n_lower FROM r_{table}"""


@query("dq_case_variants", " UNION ALL ".join(
    _VARIANT_SQL.format(column=column, table="orders") for column in ("status", "created_at", "pay_time")))
def dq_case_variants(t):
    return dq.case_variants(t.table("orders"))


@query("dq_all_null",
       """SELECT 'parent_id' AS "column", count(*) AS n_rows FROM r_categories WHERE parent_id IS NULL""")
def dq_all_null(t):
    """First-level categories: their parent is missing in every row."""
    return dq.null_columns(t.table("categories").where(F.col("parent_id").isNull()))


@query("dq_empty",
       """SELECT 'empty' AS rule, CAST(NULL AS VARCHAR) AS "column", 'no rows' AS detail
          WHERE NOT EXISTS (SELECT 1 FROM r_orders WHERE total_amount > 1000000000)""")
def dq_empty(t):
    return dq.empty_issue(t.table("orders").where(F.col("total_amount") > 1_000_000_000))


@query("dq_issue_report",
       """SELECT 'case_variants' AS rule, 'method' AS "column",
                 concat(CAST(count(DISTINCT method) AS VARCHAR), ' values, ', CAST(count(DISTINCT lower(method)) AS VARCHAR),
                        ' without case') AS detail FROM r_payments
          HAVING count(DISTINCT lower(method)) < count(DISTINCT method)
          UNION ALL SELECT 'all_null', 'note', 'only NULL' WHERE EXISTS (SELECT 1 FROM r_payments)""")
def dq_issue_report(t):
    return dq.issue_report(t.table("payments").withColumn("note", F.lit(None).cast("int")))


@query("dq_issue_report_empty",
       """SELECT 'empty' AS rule, CAST(NULL AS VARCHAR) AS "column", 'no rows' AS detail
          WHERE NOT EXISTS (SELECT 1 FROM r_payments WHERE amount > 1000000000)""")
def dq_issue_report_empty(t):
    """An empty table has one issue, not one per column."""
    return dq.issue_report(t.table("payments").where(F.col("amount") > 1_000_000_000))


@query("dq_null_amount", "SELECT id, user_id FROM r_orders WHERE total_amount IS NULL")
def dq_null_amount(t):
    return dq.null_values(t.table("orders"), "total_amount").select("id", "user_id")


@query("dq_negative_amount", "SELECT id, CAST(amount AS DOUBLE) AS amount FROM r_payments WHERE amount < 0")
def dq_negative_amount(t):
    return dq.negative_values(t.table("payments"), "amount").select("id", F.col("amount").cast("double").alias("amount"))


@query("dq_out_of_range", "SELECT id, rating FROM r_reviews WHERE rating < 1 OR rating > 5")
def dq_out_of_range(t):
    return dq.out_of_range(t.table("reviews"), "rating", 1, 5).select("id", "rating")


@query("dq_missing_ref", "SELECT id FROM r_products WHERE category_id IS NULL")
def dq_missing_ref(t):
    return dq.null_values(t.table("products"), "category_id").select("id")


@query("dq_orphans",
       """SELECT o.user_id, count(*) AS n FROM r_orders o WHERE o.user_id IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM r_users u WHERE u.id = o.user_id AND u.is_deleted = 0) GROUP BY o.user_id""")
def dq_orphans(t):
    """Orders whose user is gone."""
    return dq.orphans(t.table("orders"), "user_id", t.table("users").where(F.col("is_deleted") == 0))


@query("dq_duplicates",
       """SELECT min(id) AS kept, count(*) AS copies FROM r_orders
          GROUP BY user_id, status, total_amount, created_at, pay_time HAVING count(*) > 1""")
def dq_duplicates(t):
    content = ["user_id", "status", "total_amount", "created_at", "pay_time"]
    return dq.duplicates(t.table("orders"), "id", content).select("kept", "copies")


@query("dq_bad_email",
       """SELECT email, min(id) AS first_id, count(*) AS n,
                 NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS malformed, count(*) > 1 AS reused
          FROM r_users GROUP BY email
          HAVING count(*) > 1 OR NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')""")
def dq_bad_email(t):
    return dq.bad_emails(t.table("users"), "id", "email")


@query("dq_price_outlier", "SELECT id, CAST(price AS DOUBLE) AS price FROM r_products WHERE price = 999999")
def dq_price_outlier(t):
    found = dq.outliers(t.table("products").select("id", "category_id", "price"), "price", "category_id", k=20.0)
    return found.select("id", F.col("price").cast("double").alias("price"))


@query("dq_price_fences",
       """WITH q AS (SELECT category_id, count(*) AS n, quantile_cont(CAST(price AS DOUBLE), 0.25) AS q1,
                            quantile_cont(CAST(price AS DOUBLE), 0.75) AS q3 FROM r_products WHERE price IS NOT NULL
                     GROUP BY category_id)
          SELECT q.category_id, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3,
                 count(CASE WHEN p.price < q1 - 3 * (q3 - q1) THEN 1 END) AS below,
                 count(CASE WHEN p.price > q3 + 3 * (q3 - q1) THEN 1 END) AS above
          FROM q JOIN r_products p ON p.category_id IS NOT DISTINCT FROM q.category_id GROUP BY q.category_id""")
def dq_price_fences(t):
    """Quartiles of each category and how many prices lie beyond its fences on either side."""
    prices = t.table("products").select("id", "category_id", "price")
    limits = fences(prices, "price", "category_id", 3.0)
    counted = prices.groupBy(F.struct(F.col("category_id").alias("value")).alias("of_group"), "price").agg(F.count("*").alias("rows"))
    return counted.join(limits, "of_group").groupBy("of_group", "n", "q1", "q3").agg(
        F.sum(F.when(F.col("price") < F.col("low_fence"), F.col("rows")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("price") > F.col("high_fence"), F.col("rows")).otherwise(0)).alias("above"),
    ).select(F.col("of_group.value").alias("category_id"), "n", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"), "below", "above")


@query("dq_amount_fences",
       """WITH q AS (SELECT l_returnflag AS flag, count(*) AS n, quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.25) AS q1,
                            quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.75) AS q3 FROM lineitem GROUP BY l_returnflag)
          SELECT l_orderkey, l_linenumber, l_returnflag AS flag, CAST(l_extendedprice AS DOUBLE) AS amount
          FROM lineitem JOIN q ON l_returnflag IS NOT DISTINCT FROM flag
          WHERE l_extendedprice < q1 - 0.5 * (q3 - q1) OR l_extendedprice > q3 + 0.5 * (q3 - q1)""")
def dq_amount_fences(t):
    """Lines far from the usual amounts of lines with their flag, on either side."""
    lines = t.base("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"),
                                      F.col("l_extendedprice").cast("double").alias("amount"))
    return dq.outliers(lines, "amount", "flag", k=0.5)


@query("dq_money_precision",
       """SELECT id, CAST(discount AS DOUBLE) AS discount FROM r_order_items
          WHERE CAST(discount * 10000 AS BIGINT) % 100 <> 0""")
def dq_money_precision(t):
    found = dq.too_precise(t.table("order_items"), "discount")
    return found.select("id", F.col("discount").cast("double").alias("discount"))
