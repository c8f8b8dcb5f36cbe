"""Queries that show one relational operator each: scans, filters, joins, aggregates, windows, top-n."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.functions.dates import day_key, days, month, month_key
from tallyfold.functions.money import as_number, line_amount, ratio, rounded_ratio
from tallyfold.operators.relational import (
    category_paths,
    lines_of,
    not_in,
    refunded_by_product,
    roll_up,
    row_count,
    sums_by,
    top_n,
    total_ratio,
    without_match,
)
from tallyfold.operators.results import capped
from tallyfold.operators.sketches import ERROR, daily_sketches, distinct_in
from tallyfold.operators.windows import best_per_group, day_runs, period_growth, ranked_top
from tallyfold.plans import grouped_questions as grouped
from tallyfold.plans import simple_questions as simple
from tallyfold.plans.registry import query
from tallyfold.session import fresh_path
from tallyfold.sources.mapped import TABLES
from tallyfold.sources.tables import data_range, table_counts

MARCH = month("1996-03")
FIRST_QUARTER = days("1996-01-01", "1996-03-31")


# Scans and catalogue

@query("scan_table", "SELECT id, user_id, province, city, detail, is_default FROM r_addresses")
def scan_table(t, name: str = "addresses"):
    return t.table(name)


_BASE_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double",
               "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}
@query("data_range", "SELECT min(date) AS first_day, max(date) AS last_day FROM r_daily_product_metrics")
def date_span(t):
    """The per-day table exists for days of its source, so the source column alone answers."""
    return data_range(t.base("lineitem"), "l_shipdate")


@query("table_counts", " UNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS n FROM r_{name}" for name in TABLES))
def counts(t):
    return table_counts({name: t.table(name) for name in TABLES})


@query("capped_result",
       """SELECT id, total_amount, (SELECT count(*) FROM r_orders) > 200 AS truncated FROM (
            SELECT id, CAST(total_amount AS DOUBLE) AS total_amount FROM r_orders
            ORDER BY total_amount DESC NULLS LAST, id LIMIT 200) top""")
def capped_result(t, max_rows: int = 200):
    orders = t.table("orders").select("id", F.col("total_amount").cast("double").alias("total_amount"))
    return capped(orders, [F.desc_nulls_last("total_amount"), F.asc("id")], max_rows)


@query("capped_result_whole",
       "SELECT id, name, false AS truncated FROM r_categories ORDER BY id")
def capped_result_whole(t):
    return capped(t.table("categories").select("id", "name"), [F.asc("id")])


# Filters and projections

@query("f_equals",
       """SELECT count(*) AS n, count(CASE WHEN stock >= 4000 THEN 1 END) AS well_stocked
          FROM r_products WHERE seller_id = 8""")
def f_equals(t):
    return t.table("products").where(F.col("seller_id") == 8).agg(
        F.count("*").alias("n"), F.count_if(F.col("stock") >= 4000).alias("well_stocked")
    )


@query("f_conjunction",
       """SELECT count(*) AS n FROM r_orders WHERE lower(status) = 'completed' AND total_amount > 100000
          AND user_id <= 700""")
def f_conjunction(t):
    wanted = (F.lower("status") == "completed") & (F.col("total_amount") > 100000) & (F.col("user_id") <= 700)
    return row_count(t.table("orders").where(wanted))


@query("f_in", "SELECT count(*) AS n FROM r_payments WHERE method IN ('wechat', 'Wechat')")
def f_in(t):
    return row_count(t.table("payments").where(F.col("method").isin("wechat", "Wechat")))


@query("f_between", "SELECT count(*) AS n FROM r_orders WHERE total_amount BETWEEN 50000 AND 60000")
def f_between(t):
    return row_count(t.table("orders").where(F.col("total_amount").between(50000, 60000)))


@query("f_is_null", "SELECT count(*) AS n FROM r_products WHERE category_id IS NULL")
def f_is_null(t):
    return row_count(t.table("products").where(F.col("category_id").isNull()))


@query("f_not_null", "SELECT count(*) AS n FROM r_user_coupons WHERE used_at IS NOT NULL")
def f_not_null(t):
    return row_count(t.table("user_coupons").where(F.col("used_at").isNotNull()))


@query("f_prefix",
       """SELECT count(*) AS n, CAST(sum(orders) AS BIGINT) AS orders FROM r_daily_product_metrics
          WHERE date LIKE '1997-11%'""")
def f_prefix(t):
    """A month prefix on a day column is a range on its typed column, which prunes the scan."""
    metrics = t.table("daily_product_metrics", month("1997-11"))
    return metrics.agg(F.count("*").alias("n"), F.sum("orders").alias("orders"))


@query("f_contains", "SELECT count(*) AS n FROM r_reviews WHERE content LIKE '%VIEW%' OR lower(content) LIKE '%\"k\": 7%'")
def f_contains(t):
    content = F.col("content")
    return row_count(t.table("reviews").where(content.contains("VIEW") | F.lower(content).contains('"k": 7')))


@query("f_month_normalized",
       """SELECT count(*) AS n FROM r_payments WHERE paid_at LIKE '1996-03%' OR paid_at LIKE '1996/03%'""")
def f_month_normalized(t):
    """On text alone: for tables nobody has given a typed column yet."""
    return row_count(t.table("payments").where(month_key(F.col("paid_at")) == "1996-03"))


@query("f_day_compare",
       """SELECT count(CASE WHEN paid_ts < TIMESTAMP '1996-03-16 00:00:00' THEN 1 END) AS up_to,
                 count(CASE WHEN paid_ts >= TIMESTAMP '1996-03-16 00:00:00' THEN 1 END) AS after FROM r_payments""")
def f_day_compare(t):
    day = day_key(F.col("paid_at"))
    return t.table("payments").agg(
        F.count_if(day <= "1996-03-15").alias("up_to"), F.count_if(day > "1996-03-15").alias("after")
    )


@query("f_case_insensitive", "SELECT count(*) AS n FROM r_payments WHERE lower(method) = 'wechat'")
def f_case_insensitive(t):
    return row_count(t.table("payments").where(F.lower("method") == "wechat"))


@query("p_line_amount",
       """SELECT id, CAST((unit_price - discount) * quantity AS DOUBLE) AS amount FROM r_order_items""")
def p_line_amount(t):
    return t.table("order_items").select("id", line_amount().cast("double").alias("amount"))


@query("p_min_fields", "SELECT id, city FROM r_users")
def p_min_fields(t):
    return t.table("users").select("id", "city")


# Joins

@query("j_inner",
       """SELECT u.vip_level, count(*) AS cnt FROM r_reviews r JOIN r_users u ON r.user_id = u.id GROUP BY u.vip_level""")
def j_inner(t):
    return roll_up(t.table("reviews"), "user_id", t.table("users"), ["vip_level"], cnt="1")


@query("j_hierarchy",
       """SELECT p.id, p.name, c.name AS category, l1.name AS top FROM r_products p
          JOIN r_categories c ON p.category_id = c.id JOIN r_categories l1 ON c.parent_id = l1.id""")
def j_hierarchy(t):
    return grouped.products_with_path(t).select("id", "name", "category", "top")


@query("j_star4",
       """SELECT p.status AS status, c.name AS category, count(*) AS lines, CAST(sum(oi.quantity) AS BIGINT) AS pieces
          FROM r_order_items oi JOIN r_orders o ON oi.order_id = o.id JOIN r_products p ON oi.product_id = p.id
          JOIN r_categories c ON p.category_id = c.id
          WHERE replace(substr(o.created_at, 1, 7), '/', '-') IN ('1996-01', '1996-02', '1996-03')
          GROUP BY p.status, c.name""")
def j_star4(t):
    chosen = lines_of(t.table("order_items"), t.table("orders", FIRST_QUARTER))
    per_group = roll_up(chosen, "product_id", t.table("products"), ["status", "category_id"], lines="1", pieces="quantity")
    named = per_group.join(category_paths(t.table("categories")).select("category_id", "category"), "category_id")
    return sums_by(named, "status", "category", lines="lines", pieces="pieces")


@query("j_star5",
       """SELECT l1.id AS top_id, min(l1.name) AS top, count(*) AS refunds, count(DISTINCT p.id) AS products
          FROM r_refunds r JOIN r_order_items oi ON r.order_item_id = oi.id JOIN r_products p ON oi.product_id = p.id
          JOIN r_categories c ON p.category_id = c.id JOIN r_categories l1 ON c.parent_id = l1.id GROUP BY l1.id""")
def j_star5(t):
    per_item = sums_by(t.table("refunds"), "order_item_id", refunds="1")
    items = t.table("order_items").select(F.col("id").alias("order_item_id"), "product_id")
    per_product = sums_by(items.join(per_item, "order_item_id"), "product_id", refunds="refunds")
    products = per_product.join(t.table("products").select(F.col("id").alias("product_id"), "category_id"), "product_id")
    per_category = sums_by(products, "category_id", refunds="refunds", products="1")
    return roll_up(per_category, "category_id", category_paths(t.table("categories")), ["top_id", "top"], "category_id",
                   refunds="refunds", products="products")


@query("j_anti_exists", "SELECT u.id FROM r_users u WHERE NOT EXISTS (SELECT 1 FROM r_user_coupons c WHERE c.user_id = u.id)")
def j_anti_exists(t):
    return without_match(t.table("users").select("id"), "id", t.table("user_coupons"), "user_id")


@query("j_anti_exists_pred",
       """SELECT u.id FROM r_users u WHERE u.vip_level >= 2 AND NOT EXISTS (SELECT 1 FROM r_orders o
          WHERE o.user_id = u.id AND replace(substr(o.created_at, 1, 4), '/', '-') = '1997')""")
def j_anti_exists_pred(t):
    vips = t.table("users").where(F.col("vip_level") >= 2).select("id")
    return without_match(vips, "id", t.table("orders", days("1997-01-01", "1997-12-31")), "user_id")


@query("j_anti_exists_join",
       """SELECT p.id FROM r_products p WHERE NOT EXISTS (SELECT 1 FROM r_order_items oi JOIN r_refunds r
          ON r.order_item_id = oi.id WHERE oi.product_id = p.id AND substr(r.refunded_at, 1, 4) = '1999')""")
def j_anti_exists_join(t):
    refunded = refunded_by_product(t.table("order_items"), t.table("refunds", days("1999-01-01", "1999-12-31")))
    return without_match(t.table("products").select("id"), "id", refunded, "product_id")


@query("j_anti_not_in",
       """SELECT id FROM r_categories WHERE id NOT IN (SELECT category_id FROM r_products
          WHERE category_id IS NOT NULL AND price > 999990)""")
def j_anti_not_in(t):
    priced = t.table("products").where(F.col("category_id").isNotNull() & (F.col("price") > 999990))
    return not_in(t.table("categories").select("id"), "id", priced, "category_id")


@query("j_anti_not_in_null",
       """SELECT id FROM r_categories WHERE id NOT IN (SELECT category_id FROM r_products WHERE price > 900)""")
def j_anti_not_in_null(t):
    """The subquery yields a NULL, so nothing can be known to be absent from it."""
    priced = t.table("products").where(F.col("price") > 900)
    return not_in(t.table("categories").select("id"), "id", priced, "category_id")


@query("j_never_paid",
       """SELECT DISTINCT o.user_id FROM r_orders o
          WHERE replace(substr(o.created_at, 1, 7), '/', '-') IN ('1996-01', '1996-02', '1996-03') AND NOT EXISTS (
            SELECT 1 FROM r_payments p JOIN r_orders paid ON p.order_id = paid.id
            WHERE p.status = 'success' AND paid.user_id = o.user_id)""")
def j_never_paid(t):
    """Buyers of a quarter who never had a successful payment at all."""
    settled = t.table("payments").where(F.col("status") == "success").select(F.col("order_id").alias("id"))
    paid_users = t.table("orders").select("id", "user_id").join(settled, "id", "left_semi")
    buyers = t.table("orders", FIRST_QUARTER).select("user_id").distinct()
    return without_match(buyers, "user_id", paid_users, "user_id")


@query("j_scalar_eq", "SELECT id, name FROM r_products WHERE price = (SELECT max(price) FROM r_products)")
def j_scalar_eq(t):
    return grouped.rows_at_maximum(t.table("products").select("id", "name", "price"), "price").select("id", "name")


@query("j_corr_scalar",
       """WITH owned AS (SELECT i.id AS line, p.seller_id AS seller, (i.unit_price - i.discount) * i.quantity AS sold
                         FROM r_products p JOIN r_order_items i ON i.product_id = p.id),
               sold AS (SELECT seller, sum(sold) AS amt FROM owned GROUP BY seller),
               back AS (SELECT seller, sum(amount) AS amt FROM r_refunds JOIN owned ON line = order_item_id GROUP BY seller)
          SELECT r_sellers.id AS seller_id, CAST(coalesce(back.amt, 0) AS DOUBLE) AS refund_amt,
                 CAST(coalesce(sold.amt, 0) AS DOUBLE) AS sales_amt
          FROM r_sellers LEFT JOIN sold ON sold.seller = r_sellers.id LEFT JOIN back ON back.seller = r_sellers.id""")
def j_corr_scalar(t):
    per_product = grouped.refunds_and_sales(t.table("order_items"), t.table("refunds"), line_amount())
    per_seller = roll_up(per_product, "product_id", t.table("products"), ["seller_id"], sold="sold", refunded="refunded")
    sellers = t.table("sellers").select(F.col("id").alias("seller_id")).join(per_seller, "seller_id", "left")
    return sellers.select(
        "seller_id",
        as_number(F.coalesce("refunded", F.lit(0))).alias("refund_amt"),
        as_number(F.coalesce("sold", F.lit(0))).alias("sales_amt"),
    )


@query("j_left",
       """SELECT u.id, count(r.id) AS reviews FROM r_users u LEFT JOIN r_reviews r ON r.user_id = u.id GROUP BY u.id""")
def j_left(t):
    reviews = sums_by(t.table("reviews"), "user_id", reviews="1").withColumnRenamed("user_id", "id")
    joined = t.table("users").select("id").join(reviews, "id", "left")
    return joined.withColumn("reviews", F.coalesce("reviews", F.lit(0)))


# Aggregates

@query("a_count", "SELECT count(*) AS n, count(total_amount) AS with_amount FROM r_orders")
def a_count(t):
    return t.table("orders").agg(F.count("*").alias("n"), F.count("total_amount").alias("with_amount"))


@query("a_sum", "SELECT round(CAST(sum(amount) AS DOUBLE), 4) AS total FROM r_payments")
def a_sum(t):
    return t.table("payments").agg(as_number(F.sum("amount")).alias("total"))


@query("a_avg", "SELECT round(CAST(sum(amount) AS DOUBLE) / count(amount), 4) AS mean FROM r_daily_user_activity")
def a_avg(t):
    return simple.mean_of(t.table("daily_user_activity"), "amount")


@query("a_min", "SELECT CAST(min(total_amount) AS DOUBLE) AS lowest FROM r_orders WHERE lower(status) = 'paid'")
def a_min(t):
    return t.table("orders").where(F.lower("status") == "paid").agg(as_number(F.min("total_amount")).alias("lowest"))


@query("a_max", "SELECT CAST(max(amount) AS DOUBLE) AS highest FROM r_refunds")
def a_max(t):
    return t.table("refunds").agg(as_number(F.max("amount")).alias("highest"))


@query("a_count_distinct", "SELECT count(DISTINCT product_id) AS n FROM r_order_items")
def a_count_distinct(t):
    return t.table("order_items").agg(F.count_distinct("product_id").alias("n"))


@query("a_count_distinct_sketch",
       """SELECT period, count(DISTINCT l_partkey) AS n, true AS within FROM lineitem
          JOIN (VALUES ('quarter', DATE '1996-01-01', DATE '1996-03-31'), ('all', DATE '1900-01-01', DATE '2100-01-01')) r(period, a, b)
            ON CAST(l_shipdate AS DATE) BETWEEN a AND b GROUP BY period""")
def a_count_distinct_sketch(t):
    """Exact counts beside those of stored daily sketches, and whether these are as near as promised."""
    lines = t.base("lineitem").select(F.col("l_shipdate").cast("date").alias("day"), "l_partkey")
    path = fresh_path(t.spark, "sketches")
    daily_sketches(lines, "day", "l_partkey").write.parquet(path)
    sketches = t.spark.read.parquet(path)

    def compared(period, during):
        chosen = lines if during is None else lines.where(during.holds(F.col("day"), "date"))
        counts = chosen.agg(F.count_distinct("l_partkey").alias("n"))
        near = F.abs(F.lit(1) - distinct_in(sketches, during).scalar() / F.col("n")) <= ERROR
        return counts.select(F.lit(period).alias("period"), "n", near.alias("within"))

    return compared("quarter", FIRST_QUARTER).unionByName(compared("all", None))


@query("a_count_distinct_expr", "SELECT count(DISTINCT lower(status)) AS n FROM r_orders")
def a_count_distinct_expr(t):
    return t.table("orders").agg(F.count_distinct(F.lower("status")).alias("n"))


@query("a_group", "SELECT city, is_default, count(*) AS cnt FROM r_addresses GROUP BY city, is_default")
def a_group(t):
    return sums_by(t.table("addresses"), "city", "is_default", cnt="1")


@query("a_group_normalized",
       """SELECT lower(method) AS method, count(*) AS cnt, round(CAST(sum(amount) AS DOUBLE), 4) AS amt
          FROM r_payments GROUP BY lower(method)""")
def a_group_normalized(t):
    return t.table("payments").groupBy(F.lower("method").alias("method")).agg(
        F.count("*").alias("cnt"), as_number(F.sum("amount")).alias("amt")
    )


@query("a_group_dependent",
       """SELECT s.id AS seller_id, min(s.name) AS seller, count(*) AS cnt FROM r_products p
          JOIN r_sellers s ON p.seller_id = s.id GROUP BY s.id""")
def a_group_dependent(t):
    sellers = t.table("sellers").select(F.col("id").alias("seller_id"), F.col("name").alias("seller"))
    return sums_by(t.table("products"), "seller_id", cnt="1").join(sellers, "seller_id")


@query("a_having", "SELECT user_id, count(*) AS cnt FROM r_orders GROUP BY user_id HAVING count(*) >= 15")
def a_having(t):
    return sums_by(t.table("orders"), "user_id", cnt="1").where(F.col("cnt") >= 15)


@query("a_conditional",
       """SELECT lower(status) AS status,
                 CAST(sum(CASE WHEN total_amount < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
                 CAST(sum(CASE WHEN total_amount < 0 THEN total_amount END) AS DOUBLE) AS negative_amt
          FROM r_orders GROUP BY lower(status)""")
def a_conditional(t):
    negative = F.col("total_amount") < 0
    return t.table("orders").groupBy(F.lower("status").alias("status")).agg(
        F.sum(F.when(negative, 1).otherwise(0)).alias("negatives"),
        as_number(F.sum(F.when(negative, F.col("total_amount")))).alias("negative_amt"),
    )


@query("a_conditional_distinct",
       """SELECT device, count(DISTINCT CASE WHEN orders > 0 THEN user_id END) AS buyers, count(DISTINCT user_id) AS users
          FROM r_daily_user_activity WHERE date <= '2024-01-02' GROUP BY device""")
def a_conditional_distinct(t):
    active = t.table("daily_user_activity", days("2024-01-01", "2024-01-02"))
    per_user = active.groupBy("device", "user_id").agg(F.max(F.col("orders") > 0).alias("bought"))
    return per_user.groupBy("device").agg(F.count_if("bought").alias("buyers"), F.count("*").alias("users"))


@query("a_ratio",
       """SELECT lower(method) AS method, round(CAST(sum(amount) AS DOUBLE) / count(DISTINCT order_id), 4) AS per_order
          FROM r_payments GROUP BY lower(method)""")
def a_ratio(t):
    return t.table("payments").groupBy(F.lower("method").alias("method")).agg(
        rounded_ratio(F.sum("amount"), F.count_distinct("order_id"), 4).alias("per_order")
    )


@query("a_ratio_two_facts",
       """SELECT round(CAST((SELECT sum(amount) FROM r_refunds) AS DOUBLE) /
                 CAST((SELECT sum(amount) FROM r_payments WHERE status = 'success') AS DOUBLE), 6) AS share""")
def a_ratio_two_facts(t):
    paid = t.table("payments").where(F.col("status") == "success")
    return total_ratio(t.table("refunds"), F.col("amount"), paid, F.col("amount"), "share")


@query("a_nested",
       """SELECT max(n) AS most, round(CAST(sum(n) AS DOUBLE) / count(n), 4) AS mean FROM (
            SELECT user_id, count(*) AS n FROM r_orders GROUP BY user_id) per_user""")
def a_nested(t):
    per_user = sums_by(t.table("orders"), "user_id", n="1")
    return per_user.agg(F.max("n").alias("most"), rounded_ratio(F.sum("n"), F.count("n"), 4).alias("mean"))


@query("a_share",
       """SELECT round(count(*) * 1.0 / (SELECT count(DISTINCT product_id) FROM r_order_items), 6) AS share
          FROM (SELECT product_id FROM r_order_items GROUP BY product_id HAVING count(*) >= 35) often""")
def a_share(t):
    per_product = sums_by(t.table("order_items"), "product_id", n="1")
    return per_product.agg(rounded_ratio(F.count_if(F.col("n") >= 35), F.count("product_id")).alias("share"))


@query("a_spread",
       """SELECT round(max(per_order) / min(per_order), 4) AS spread FROM (
            SELECT order_id % 10 AS digit, CAST(sum(quantity) AS DOUBLE) / count(DISTINCT order_id) AS per_order
            FROM r_order_items GROUP BY order_id % 10) per_digit""")
def a_spread(t):
    per_order = sums_by(t.table("order_items"), "order_id", pieces="quantity")
    per_digit = per_order.groupBy((F.col("order_id") % 10).alias("digit")).agg(
        ratio(F.sum("pieces"), F.count("*")).alias("per_order")
    )
    return per_digit.agg(rounded_ratio(F.max("per_order"), F.min("per_order"), 4).alias("spread"))


@query("a_daily_series",
       """SELECT replace(substr(paid_at, 1, 10), '/', '-') AS day, count(*) AS cnt, count(DISTINCT method) AS methods
          FROM r_payments GROUP BY 1""")
def a_daily_series(t):
    day = F.to_date("paid_ts").cast("string").alias("day")
    return t.table("payments").groupBy(day).agg(
        F.count("*").alias("cnt"), F.count_distinct("method").alias("methods")
    )


@query("a_monthly_series",
       """SELECT replace(substr(refunded_at, 1, 7), '/', '-') AS mon, count(*) AS cnt,
                 round(CAST(sum(amount) AS DOUBLE), 4) AS amt FROM r_refunds GROUP BY 1""")
def a_monthly_series(t):
    mon = F.date_format("refunded_ts", "yyyy-MM").alias("mon")
    return t.table("refunds").groupBy(mon).agg(F.count("*").alias("cnt"), as_number(F.sum("amount")).alias("amt"))


# Windows, top-n, scalar functions, common table expressions

@query("w_rank_topn",
       """SELECT user_id, cnt, rk FROM (SELECT user_id, count(*) AS cnt, rank() OVER (ORDER BY count(*) DESC) AS rk
          FROM r_orders GROUP BY user_id) ranked WHERE rk <= 10""")
def w_rank_topn(t):
    return ranked_top(sums_by(t.table("orders"), "user_id", cnt="1"), "cnt", 10)


@query("w_top1_per_group",
       """SELECT seller_id, product_id FROM (SELECT p.seller_id, p.id AS product_id,
            row_number() OVER (PARTITION BY p.seller_id ORDER BY sum(oi.quantity) DESC, p.id) AS rn
          FROM r_order_items oi JOIN r_products p ON oi.product_id = p.id GROUP BY p.seller_id, p.id) ranked WHERE rn = 1""")
def w_top1_per_group(t):
    sold = sums_by(t.table("order_items"), "product_id", pieces="quantity")
    products = t.table("products").select(F.col("id").alias("product_id"), "seller_id")
    best = best_per_group(sold.join(products, "product_id"), ["seller_id"], [F.desc("pieces"), F.asc("product_id")])
    return best.select("seller_id", "product_id")


@query("w_lag_growth",
       """WITH months AS (SELECT date_trunc('month', refunded_ts) AS first, count(*) AS cnt FROM r_refunds GROUP BY 1),
               before AS (SELECT m.first, max(b.first) AS earlier FROM months m LEFT JOIN months b ON b.first < m.first
                          GROUP BY m.first)
          SELECT strftime(m.first, '%Y-%m') AS mon, m.cnt, round(CAST(m.cnt AS DOUBLE) / b.cnt - 1, 6) AS growth
          FROM months m JOIN before USING (first) LEFT JOIN months b ON b.first = before.earlier""")
def w_lag_growth(t):
    return period_growth(a_monthly_series(t).select("mon", "cnt"), "mon", "cnt")


@query("w_islands",
       """WITH active AS (SELECT DISTINCT user_id, day FROM r_daily_user_activity),
               starts AS (SELECT * FROM active a WHERE NOT EXISTS (
                            SELECT 1 FROM active x WHERE x.user_id = a.user_id AND x.day = a.day - 1)),
               ends AS (SELECT * FROM active a WHERE NOT EXISTS (
                            SELECT 1 FROM active x WHERE x.user_id = a.user_id AND x.day = a.day + 1))
          SELECT s.user_id, CAST(s.day AS VARCHAR) AS first_day, CAST(min(e.day) - s.day + 1 AS BIGINT) AS length
          FROM starts s JOIN ends e ON e.user_id = s.user_id AND e.day >= s.day
          GROUP BY s.user_id, s.day HAVING min(e.day) - s.day >= 2""")
def w_islands(t):
    runs = day_runs(t.table("daily_user_activity"), "user_id", "day", 3)
    return runs.withColumn("first_day", F.col("first_day").cast("string"))


@query("t_top_n",
       """SELECT user_id, CAST(sum(total_amount) AS DOUBLE) AS spent FROM r_orders GROUP BY user_id
          ORDER BY sum(total_amount) DESC NULLS LAST, user_id LIMIT 10""")
def t_top_n(t):
    spent = sums_by(t.table("orders"), "user_id", spent="total_amount")
    picked = top_n(spent, 10, [F.desc_nulls_last("spent"), F.asc("user_id")])
    return picked.withColumn("spent", as_number(F.col("spent")))


@query("t_bottom_n",
       """SELECT user_id, CAST(min(total_amount) AS DOUBLE) AS least, count(*) AS cnt FROM r_orders GROUP BY user_id
          HAVING count(*) >= 5 ORDER BY min(total_amount) NULLS LAST, user_id LIMIT 10""")
def t_bottom_n(t):
    per_user = t.table("orders").groupBy("user_id").agg(F.min("total_amount").alias("least"), F.count("*").alias("cnt"))
    picked = top_n(per_user.where(F.col("cnt") >= 5), 10, [F.asc_nulls_last("least"), F.asc("user_id")])
    return picked.withColumn("least", as_number(F.col("least")))


@query("t_top_days",
       """SELECT replace(substr(refunded_at, 1, 10), '/', '-') AS day, count(*) AS cnt FROM r_refunds
          GROUP BY 1 ORDER BY cnt DESC, day LIMIT 7""")
def t_top_days(t):
    per_day = t.table("refunds").groupBy(F.to_date("refunded_ts").cast("string").alias("day")).agg(F.count("*").alias("cnt"))
    return top_n(per_day, 7, [F.desc("cnt"), F.asc("day")])


@query("scalar_functions",
       """SELECT id, lower(status) AS lowered, substr(created_at, 1, 7) AS head,
                 replace(substr(created_at, 1, 10), '/', '-') AS day, CAST(substr(created_at, 1, 4) AS INTEGER) AS year,
                 CAST(coalesce(total_amount, 0) AS DOUBLE) AS amount,
                 CASE WHEN total_amount < 0 THEN 'negative' WHEN total_amount IS NULL THEN 'missing' ELSE 'normal' END AS kind,
                 CAST(round(total_amount, 0) AS DOUBLE) AS rounded, nullif(lower(status), 'paid') AS not_paid,
                 CAST(CAST(created_ts AS DATE) - DATE '1995-01-01' AS BIGINT) AS day_number,
                 strftime(created_ts, '%Y-%m') AS mon
          FROM r_orders""")
def scalar_functions(t):
    created, amount, status = F.col("created_at"), F.col("total_amount"), F.lower("status")
    return t.table("orders").select(
        "id",
        status.alias("lowered"),
        F.substring(created, 1, 7).alias("head"),
        F.replace(F.substring(created, 1, 10), F.lit("/"), F.lit("-")).alias("day"),
        F.substring(created, 1, 4).try_cast("int").alias("year"),
        F.coalesce(amount, F.lit(0)).cast("double").alias("amount"),
        F.when(amount < 0, "negative").when(amount.isNull(), "missing").otherwise("normal").alias("kind"),
        F.round(amount, 0).cast("double").alias("rounded"),
        F.nullif(status, F.lit("paid")).alias("not_paid"),
        F.datediff("created_ts", F.lit("1995-01-01").cast("date")).cast("long").alias("day_number"),
        F.date_format("created_ts", "yyyy-MM").alias("mon"),
    )


@query("common_table_expression",
       """WITH busy AS (SELECT user_id, count(*) AS cnt FROM r_orders GROUP BY user_id HAVING count(*) >= 12)
          SELECT u.city AS city, count(*) AS users FROM busy b JOIN r_users u ON b.user_id = u.id GROUP BY u.city""")
def common_table_expression(t):
    """The same text runs as it is: a leading WITH is an ordinary query."""
    return t.spark.sql(
        """WITH busy AS (SELECT user_id, count(*) AS cnt FROM {orders} GROUP BY user_id HAVING count(*) >= 12)
           SELECT u.city AS city, count(*) AS users FROM busy b JOIN {users} u ON b.user_id = u.id GROUP BY u.city""",
        orders=t.table("orders"), users=t.table("users"),
    )
