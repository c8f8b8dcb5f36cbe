"""Grouped questions: rollups, top-n lists, time series, ratios, ranks and anti-joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.functions.dates import Days, days, month
from tallyfold.functions.money import as_number, line_amount, ratio, rounded_ratio
from tallyfold.operators.relational import (
    category_paths,
    lines_of,
    not_in,
    refunded_by_product,
    refunds_and_sales,
    roll_up,
    row_count,
    rows_at_maximum,
    sums_by,
    top_n,
    total_ratio,
    without_match,
)
from tallyfold.operators.windows import best_per_group, day_runs, period_growth, ranked_top
from tallyfold.plans.registry import query

MARCH = month("1996-03")
ONE = "1"  # a sum of ones counts rows
IN_MARCH = "replace(substr({}, 1, 7), '/', '-') = '1996-03'"


@query("orders_by_status",
       """SELECT lower(status) AS status, count(*) AS cnt, round(CAST(sum(total_amount) AS DOUBLE), 4) AS amt
          FROM r_orders GROUP BY lower(status)""")
def orders_by_status(t):
    return t.table("orders").groupBy(F.lower("status").alias("status")).agg(
        F.count("*").alias("cnt"), as_number(F.sum("total_amount")).alias("amt")
    )


@query("payments_by_method",
       "SELECT lower(method) AS method, count(*) AS cnt FROM r_payments WHERE status = 'success' GROUP BY lower(method)")
def payments_by_method(t):
    paid = t.table("payments").where(F.col("status") == "success")
    return paid.groupBy(F.lower("method").alias("method")).agg(F.count("*").alias("cnt"))


def products_with_path(t):
    return t.table("products").join(category_paths(t.table("categories")), "category_id")


@query("products_in_category",
       """SELECT count(*) AS n FROM r_products p JOIN r_categories c ON p.category_id = c.id
          WHERE c.name = 'NATION_11'""")
def products_in_category(t, category: str = "NATION_11"):
    chosen = t.table("categories").where(F.col("name") == category).select(F.col("id").alias("category_id"))
    return row_count(t.table("products").join(chosen, "category_id"))


@query("products_by_top_category",
       """SELECT l1.id AS top_id, min(l1.name) AS category, count(*) AS cnt FROM r_products p
          JOIN r_categories c ON p.category_id = c.id JOIN r_categories l1 ON c.parent_id = l1.id GROUP BY l1.id""")
def products_by_top_category(t):
    counted = roll_up(t.table("products"), "category_id", category_paths(t.table("categories")),
                      ["top_id", "top"], "category_id", cnt=ONE)
    return counted.withColumnRenamed("top", "category")


@query("on_sale_price_by_top_category",
       """SELECT l1.id AS top_id, min(l1.name) AS category,
                 round(CAST(sum(p.price) AS DOUBLE) / count(p.price), 4) AS avg_price FROM r_products p
          JOIN r_categories c ON p.category_id = c.id JOIN r_categories l1 ON c.parent_id = l1.id
          WHERE p.status = 'on_sale' GROUP BY l1.id""")
def on_sale_price_by_top_category(t):
    on_sale = t.table("products").where(F.col("status") == "on_sale")
    summed = roll_up(on_sale, "category_id", category_paths(t.table("categories")), ["top_id", "top"], "category_id",
                     total=F.col("price"), priced="cast(price IS NOT NULL AS int)")
    return summed.select("top_id", F.col("top").alias("category"),
                         rounded_ratio(F.col("total"), F.col("priced"), 4).alias("avg_price"))


@query("top_cities_in_month",
       f"""SELECT u.city AS city, count(*) AS cnt FROM r_orders o JOIN r_users u ON o.user_id = u.id
           WHERE u.city IS NOT NULL AND {IN_MARCH.format("o.created_at")}
           GROUP BY u.city ORDER BY cnt DESC, city LIMIT 5""")
def top_cities_in_month(t, during: Days = MARCH, n: int = 5):
    cities = roll_up(t.table("orders", during), "user_id", t.table("users").where(F.col("city").isNotNull()),
                     ["city"], cnt=ONE)
    return top_n(cities, n, [F.desc("cnt"), F.asc("city")])


@query("top_categories_by_sales",
       f"""SELECT c.id AS category_id, min(c.name) AS category,
                  round(CAST(sum((oi.unit_price - oi.discount) * oi.quantity) AS DOUBLE), 4) AS sales
           FROM r_order_items oi JOIN r_orders o ON oi.order_id = o.id
           JOIN r_products p ON oi.product_id = p.id JOIN r_categories c ON p.category_id = c.id
           WHERE c.parent_id IS NOT NULL AND {IN_MARCH.format("o.created_at")}
           GROUP BY c.id ORDER BY sales DESC, category_id LIMIT 5""")
def top_categories_by_sales(t, during: Days = MARCH, n: int = 5):
    sold = lines_of(t.table("order_items"), t.table("orders", during))
    per_category = roll_up(sold, "product_id", t.table("products"), ["category_id"], sales=line_amount())
    named = per_category.join(category_paths(t.table("categories")), "category_id")
    picked = top_n(named.select("category_id", "category", "sales"), n, [F.desc("sales"), F.asc("category_id")])
    return picked.withColumn("sales", as_number(F.col("sales")))


@query("worst_rated_products",
       """SELECT product_id, round(CAST(sum(rating) AS DOUBLE) / count(rating), 6) AS avg_rating FROM r_reviews
          GROUP BY product_id HAVING count(*) >= 3
          ORDER BY CAST(sum(rating) AS DOUBLE) / count(rating), product_id LIMIT 5""")
def worst_rated_products(t, min_reviews: int = 3, n: int = 5):
    rated = t.table("reviews").groupBy("product_id").agg(
        F.count("*").alias("n"), ratio(F.sum("rating"), F.count("rating")).alias("avg_rating")
    )
    enough = rated.where(F.col("n") >= min_reviews).drop("n")
    worst = top_n(enough, n, [F.asc("avg_rating"), F.asc("product_id")])
    return worst.withColumn("avg_rating", F.round("avg_rating", 6))


@query("top_sellers_by_refund",
       """SELECT s.id AS seller_id, min(s.name) AS seller, round(CAST(sum(r.amount) AS DOUBLE), 4) AS refund_amt
          FROM r_refunds r JOIN r_order_items oi ON r.order_item_id = oi.id JOIN r_products p ON oi.product_id = p.id
          JOIN r_sellers s ON p.seller_id = s.id GROUP BY s.id ORDER BY refund_amt DESC, seller_id LIMIT 5""")
def top_sellers_by_refund(t, n: int = 5):
    per_product = refunded_by_product(t.table("order_items"), t.table("refunds"))
    return _top_sellers(t, per_product, "refunded", "refund_amt", n)


@query("top_sellers_by_sales",
       """SELECT s.id AS seller_id, min(s.name) AS seller,
                 round(CAST(sum((oi.unit_price - oi.discount) * oi.quantity) AS DOUBLE), 4) AS sales
          FROM r_order_items oi JOIN r_products p ON oi.product_id = p.id JOIN r_sellers s ON p.seller_id = s.id
          GROUP BY s.id ORDER BY sales DESC, seller_id LIMIT 3""")
def top_sellers_by_sales(t, n: int = 3):
    per_product = sums_by(t.table("order_items"), "product_id", sold=line_amount())
    return _top_sellers(t, per_product, "sold", "sales", n)


def _top_sellers(t, per_product, measure: str, name: str, n: int):
    per_seller = roll_up(per_product, "product_id", t.table("products"), ["seller_id"], value=F.col(measure))
    sellers = t.table("sellers").select(F.col("id").alias("seller_id"), F.col("name").alias("seller"))
    picked = top_n(per_seller.join(sellers, "seller_id"), n, [F.desc("value"), F.asc("seller_id")])
    return picked.select("seller_id", "seller", as_number(F.col("value")).alias(name))


@query("addresses_by_province",
       "SELECT province, count(*) AS cnt FROM r_addresses WHERE province IS NOT NULL GROUP BY province")
def addresses_by_province(t):
    known = t.table("addresses").where(F.col("province").isNotNull())
    return known.groupBy("province").agg(F.count("*").alias("cnt"))


@query("orders_per_day",
       f"""SELECT replace(substr(created_at, 1, 10), '/', '-') AS day, count(*) AS cnt FROM r_orders
           WHERE {IN_MARCH.format("created_at")} GROUP BY 1""")
def orders_per_day(t, during: Days = MARCH):
    day = F.to_date("created_ts").cast("string").alias("day")
    return t.table("orders", during).groupBy(day).agg(F.count("*").alias("cnt"))


@query("refunds_per_day",
       f"""SELECT replace(substr(refunded_at, 1, 10), '/', '-') AS day, round(CAST(sum(amount) AS DOUBLE), 4) AS amt
           FROM r_refunds WHERE {IN_MARCH.format("refunded_at")} GROUP BY 1""")
def refunds_per_day(t, during: Days = MARCH):
    day = F.to_date("refunded_ts").cast("string").alias("day")
    return t.table("refunds", during).groupBy(day).agg(as_number(F.sum("amount")).alias("amt"))


@query("coupons_claimed",
       """SELECT c.id AS coupon_id, min(c.name) AS coupon, count(*) AS cnt FROM r_user_coupons uc
          JOIN r_coupons c ON uc.coupon_id = c.id GROUP BY c.id""")
def coupons_claimed(t):
    return _per_coupon(t, t.table("user_coupons"), "cnt")


@query("coupons_used_by_coupon",
       """SELECT c.id AS coupon_id, min(c.name) AS coupon, count(*) AS used_cnt FROM r_user_coupons uc
          JOIN r_coupons c ON uc.coupon_id = c.id WHERE uc.used = 1 GROUP BY c.id""")
def coupons_used_by_coupon(t):
    return _per_coupon(t, t.table("user_coupons").where(F.col("used") == 1), "used_cnt")


def _per_coupon(t, claims, name: str):
    coupons = t.table("coupons").select(F.col("id").alias("coupon_id"), F.col("name").alias("coupon"))
    return sums_by(claims, "coupon_id", **{name: ONE}).join(coupons, "coupon_id")


@query("vip_revenue_per_buyer",
       """SELECT round(CAST(sum(o.total_amount) AS DOUBLE) / count(DISTINCT o.user_id), 6) AS arppu
          FROM r_orders o JOIN r_users u ON o.user_id = u.id WHERE u.vip_level > 0""")
def vip_revenue_per_buyer(t):
    vips = t.table("users").where(F.col("vip_level") > 0).select(F.col("id").alias("user_id"))
    buyers = sums_by(t.table("orders"), "user_id", amount=F.col("total_amount")).join(vips, "user_id")
    return buyers.agg(rounded_ratio(F.sum("amount"), F.count("*")).alias("arppu"))


@query("revenue_per_buyer",
       f"""SELECT round(CAST(sum(total_amount) AS DOUBLE) / count(DISTINCT user_id), 6) AS arpu FROM r_orders
           WHERE {IN_MARCH.format("created_at")}""")
def revenue_per_buyer(t, during: Days = MARCH):
    """Buyers whose amounts are all missing still count in the denominator."""
    buyers = sums_by(t.table("orders", during), "user_id", amount=F.col("total_amount"))
    return buyers.agg(rounded_ratio(F.sum("amount"), F.count("user_id")).alias("arpu"))


@query("top_reviewed_products",
       "SELECT product_id, count(*) AS cnt FROM r_reviews GROUP BY product_id ORDER BY cnt DESC, product_id LIMIT 5")
def top_reviewed_products(t, n: int = 5):
    return _most_frequent(t.table("reviews"), "product_id", n)


@query("top_sellers_by_products",
       "SELECT seller_id, count(*) AS cnt FROM r_products GROUP BY seller_id ORDER BY cnt DESC, seller_id LIMIT 5")
def top_sellers_by_products(t, n: int = 5):
    return _most_frequent(t.table("products"), "seller_id", n)


@query("top_reviewers",
       "SELECT user_id, count(*) AS cnt FROM r_reviews GROUP BY user_id ORDER BY cnt DESC, user_id LIMIT 3")
def top_reviewers(t, n: int = 3):
    return _most_frequent(t.table("reviews"), "user_id", n)


def _most_frequent(df, key: str, n: int):
    return top_n(sums_by(df, key, cnt=ONE), n, [F.desc("cnt"), F.asc(key)])


JANUARY = month("2024-01")


@query("sessions_per_device",
       """SELECT device, CAST(sum(sessions) AS BIGINT) AS total_sessions FROM r_daily_user_activity
          WHERE date LIKE '2024-01%' GROUP BY device""")
def sessions_per_device(t, during: Days = JANUARY):
    return sums_by(t.table("daily_user_activity", during), "device", total_sessions=F.col("sessions"))


@query("users_per_device", "SELECT device, count(DISTINCT user_id) AS users FROM r_daily_user_activity GROUP BY device")
def users_per_device(t):
    return t.table("daily_user_activity").groupBy("device").agg(F.count_distinct("user_id").alias("users"))


@query("top_categories_by_price",
       """SELECT c.id AS category_id, min(c.name) AS category,
                 round(CAST(sum(p.price) AS DOUBLE) / count(p.price), 4) AS avg_price
          FROM r_products p JOIN r_categories c ON p.category_id = c.id WHERE c.parent_id IS NOT NULL
          GROUP BY c.id ORDER BY CAST(sum(p.price) AS DOUBLE) / count(p.price) DESC, category_id LIMIT 5""")
def top_categories_by_price(t, n: int = 5):
    per_category = t.table("products").groupBy("category_id").agg(
        ratio(F.sum("price"), F.count("price")).alias("avg_price")
    )
    named = per_category.join(category_paths(t.table("categories")), "category_id")
    dearest = top_n(named.select("category_id", "category", "avg_price"), n, [F.desc("avg_price"), F.asc("category_id")])
    return dearest.withColumn("avg_price", F.round("avg_price", 4))


@query("top_categories_by_stock",
       """SELECT c.id AS category_id, min(c.name) AS category, CAST(sum(p.stock) AS BIGINT) AS total_stock
          FROM r_products p JOIN r_categories c ON p.category_id = c.id WHERE c.parent_id IS NOT NULL
          GROUP BY c.id ORDER BY total_stock DESC, category_id LIMIT 3""")
def top_categories_by_stock(t, n: int = 3):
    per_category = sums_by(t.table("products"), "category_id", total_stock=F.col("stock"))
    named = per_category.join(category_paths(t.table("categories")), "category_id")
    return top_n(named.select("category_id", "category", "total_stock"), n,
                 [F.desc("total_stock"), F.asc("category_id")])


@query("top_channels_by_orders",
       """SELECT channel, CAST(sum(orders) AS BIGINT) AS total_orders FROM r_daily_user_activity
          WHERE date LIKE '2024-01%' GROUP BY channel ORDER BY total_orders DESC, channel LIMIT 5""")
def top_channels_by_orders(t, during: Days = JANUARY, n: int = 5):
    per_channel = sums_by(t.table("daily_user_activity", during), "channel", total_orders=F.col("orders"))
    return top_n(per_channel, n, [F.desc("total_orders"), F.asc("channel")])


@query("active_users_per_day",
       """SELECT date, count(DISTINCT user_id) AS active_users FROM r_daily_user_activity
          WHERE date LIKE '2024-01%' GROUP BY date""")
def active_users_per_day(t, during: Days = JANUARY):
    return t.table("daily_user_activity", during).groupBy("date").agg(F.count_distinct("user_id").alias("active_users"))


@query("top_refunded_top_categories",
       f"""SELECT l1.id AS top_id, min(l1.name) AS category, round(CAST(sum(r.amount) AS DOUBLE), 4) AS refund_amt
           FROM r_refunds r JOIN r_order_items oi ON r.order_item_id = oi.id JOIN r_products p ON oi.product_id = p.id
           JOIN r_categories c ON p.category_id = c.id JOIN r_categories l1 ON c.parent_id = l1.id
           WHERE {IN_MARCH.format("r.refunded_at")} GROUP BY l1.id ORDER BY refund_amt DESC, top_id LIMIT 3""")
def top_refunded_top_categories(t, during: Days = MARCH, n: int = 3):
    per_product = refunded_by_product(t.table("order_items"), t.table("refunds", during))
    per_category = roll_up(per_product, "product_id", t.table("products"), ["category_id"], refunded=F.col("refunded"))
    per_top = roll_up(per_category, "category_id", category_paths(t.table("categories")), ["top_id", "top"],
                      "category_id", refunded=F.col("refunded"))
    picked = top_n(per_top, n, [F.desc("refunded"), F.asc("top_id")])
    return picked.select("top_id", F.col("top").alias("category"), as_number(F.col("refunded")).alias("refund_amt"))


@query("repeat_users",
       """SELECT count(*) AS n FROM (SELECT user_id FROM r_orders GROUP BY user_id HAVING count(*) >= 10) busy""")
def repeat_users(t, min_orders: int = 10):
    per_user = sums_by(t.table("orders"), "user_id", orders=ONE)
    return per_user.agg(F.count_if(F.col("orders") >= min_orders).alias("n"))


@query("users_without_review",
       """SELECT count(*) AS n FROM r_users u
          WHERE NOT EXISTS (SELECT 1 FROM r_reviews r WHERE r.user_id = u.id)""")
def users_without_review(t):
    return row_count(without_match(t.table("users"), "id", t.table("reviews"), "user_id"))


@query("top_products_by_gmv",
       """SELECT p.id AS product_id, min(p.name) AS product, min(l1.name) AS category,
                 round(CAST(sum(d.gmv) AS DOUBLE), 4) AS total_gmv
          FROM r_daily_product_metrics d JOIN r_products p ON d.product_id = p.id
          JOIN r_categories c ON p.category_id = c.id JOIN r_categories l1 ON c.parent_id = l1.id
          WHERE d.date LIKE '1996-03%' GROUP BY p.id ORDER BY total_gmv DESC, product_id LIMIT 5""")
def top_products_by_gmv(t, during: Days = MARCH, n: int = 5):
    """Names are attached after the cut would be wrong here: products without a category drop out."""
    gmv = sums_by(t.table("daily_product_metrics", during), "product_id", gmv=F.col("gmv"))
    products = products_with_path(t).select(
        F.col("id").alias("product_id"), F.col("name").alias("product"), F.col("top").alias("category")
    )
    picked = top_n(gmv.join(products, "product_id"), n, [F.desc("gmv"), F.asc("product_id")])
    return picked.select("product_id", "product", "category", as_number(F.col("gmv")).alias("total_gmv"))


@query("refund_rate",
       """SELECT round(CAST((SELECT sum(amount) FROM r_refunds) AS DOUBLE) /
                 CAST((SELECT sum((unit_price - discount) * quantity) FROM r_order_items) AS DOUBLE), 6) AS refund_rate""")
def refund_rate(t):
    return total_ratio(t.table("refunds"), F.col("amount"), t.table("order_items"), line_amount(), "refund_rate")


@query("idle_vips",
       f"""SELECT count(*) AS n FROM r_users u WHERE u.vip_level >= 2 AND NOT EXISTS
           (SELECT 1 FROM r_orders o WHERE o.user_id = u.id AND {IN_MARCH.format("o.created_at")})""")
def idle_vips(t, level: int = 2, during: Days = MARCH):
    vips = t.table("users").where(F.col("vip_level") >= level)
    return row_count(without_match(vips, "id", t.table("orders", during), "user_id"))


@query("top_stock_outs",
       """SELECT product_id, CAST(sum(stock_out_hours) AS BIGINT) AS total_stockout FROM r_daily_product_metrics
          WHERE date LIKE '1996-03%' GROUP BY product_id ORDER BY total_stockout DESC, product_id LIMIT 3""")
def top_stock_outs(t, during: Days = MARCH, n: int = 3):
    hours = sums_by(t.table("daily_product_metrics", during), "product_id", total_stockout=F.col("stock_out_hours"))
    return top_n(hours, n, [F.desc("total_stockout"), F.asc("product_id")])


@query("repeat_buyer_share",
       """SELECT round(count(*) * 1.0 / (SELECT count(DISTINCT user_id) FROM r_orders), 6) AS repeat_rate
          FROM (SELECT user_id FROM r_orders GROUP BY user_id HAVING count(*) >= 12) busy""")
def repeat_buyer_share(t, min_orders: int = 12):
    per_user = sums_by(t.table("orders"), "user_id", orders=ONE)
    return per_user.agg(rounded_ratio(F.count_if(F.col("orders") >= min_orders), F.count("user_id")).alias("repeat_rate"))


def sessions_per_user(t, during: Days):
    return t.table("daily_user_activity", during).groupBy("channel").agg(
        ratio(F.sum("sessions"), F.count_distinct("user_id")).alias("sessions_per_user")
    )


@query("sessions_per_user_by_channel",
       """SELECT channel, round(CAST(sum(sessions) AS DOUBLE) / count(DISTINCT user_id), 6) AS sessions_per_user
          FROM r_daily_user_activity WHERE date LIKE '2024-01%' GROUP BY channel
          ORDER BY CAST(sum(sessions) AS DOUBLE) / count(DISTINCT user_id) DESC, channel LIMIT 5""")
def sessions_per_user_by_channel(t, during: Days = JANUARY, n: int = 5):
    busiest = top_n(sessions_per_user(t, during), n, [F.desc("sessions_per_user"), F.asc("channel")])
    return busiest.withColumn("sessions_per_user", F.round("sessions_per_user", 6))


@query("channel_spread",
       """SELECT round(max(per_user) / min(per_user), 4) AS spread FROM (
            SELECT channel, CAST(sum(sessions) AS DOUBLE) / count(DISTINCT user_id) AS per_user
            FROM r_daily_user_activity WHERE date LIKE '2024-01%' GROUP BY channel) per_channel""")
def channel_spread(t, during: Days = JANUARY):
    """One pass over the grouping gives both ends."""
    per_user = F.col("sessions_per_user")
    return sessions_per_user(t, during).agg(rounded_ratio(F.max(per_user), F.min(per_user), 4).alias("spread"))


@query("products_never_refunded",
       """SELECT count(*) AS n FROM r_products p WHERE NOT EXISTS (SELECT 1 FROM r_order_items oi
          JOIN r_refunds r ON r.order_item_id = oi.id WHERE oi.product_id = p.id)""")
def products_never_refunded(t, during: Days | None = None):
    refunded = refunded_by_product(t.table("order_items"), t.table("refunds", during))
    return row_count(without_match(t.table("products"), "id", refunded, "product_id"))


@query("products_not_refunded_in_month",
       f"""SELECT count(*) AS n FROM r_products p WHERE NOT EXISTS (SELECT 1 FROM r_order_items oi
           JOIN r_refunds r ON r.order_item_id = oi.id
           WHERE oi.product_id = p.id AND {IN_MARCH.format("r.refunded_at")})""")
def products_not_refunded_in_month(t, during: Days = MARCH):
    return products_never_refunded(t, during)


@query("city_ranks",
       f"""WITH placed AS (SELECT city, count(*) AS cnt FROM r_users JOIN r_orders o ON user_id = r_users.id
                           WHERE {IN_MARCH.format("o.created_at")} AND city IS NOT NULL GROUP BY city)
           SELECT city, cnt, CAST(1 + larger AS INTEGER) AS rk FROM (
             SELECT p.city, p.cnt, count(q.city) AS larger FROM placed p LEFT JOIN placed q ON q.cnt > p.cnt
             GROUP BY p.city, p.cnt) counted WHERE larger < 5""")
def city_ranks(t, during: Days = MARCH, n: int = 5):
    cities = roll_up(t.table("orders", during), "user_id", t.table("users").where(F.col("city").isNotNull()),
                     ["city"], cnt=ONE)
    return ranked_top(cities, "cnt", n)


@query("users_per_vip_level",
       "SELECT vip_level, count(*) AS cnt FROM r_users WHERE vip_level > 0 GROUP BY vip_level")
def users_per_vip_level(t):
    return sums_by(t.table("users").where(F.col("vip_level") > 0), "vip_level", cnt=ONE)


@query("busiest_days",
       f"""SELECT replace(substr(created_at, 1, 10), '/', '-') AS day, count(*) AS cnt FROM r_orders
           WHERE {IN_MARCH.format("created_at")} GROUP BY 1 ORDER BY cnt DESC, day LIMIT 3""")
def busiest_days(t, during: Days = MARCH, n: int = 3):
    return top_n(orders_per_day(t, during), n, [F.desc("cnt"), F.asc("day")])


@query("sellers_without_products",
       """SELECT count(*) AS n FROM r_sellers s
          WHERE NOT EXISTS (SELECT 1 FROM r_products p WHERE p.seller_id = s.id)""")
def sellers_without_products(t):
    return row_count(without_match(t.table("sellers"), "id", t.table("products"), "seller_id"))


@query("mean_items_per_order",
       f"""SELECT round(CAST(sum(n) AS DOUBLE) / count(n), 6) AS mean_items FROM (
             SELECT count(*) AS n FROM r_order_items oi JOIN r_orders o ON oi.order_id = o.id
             WHERE {IN_MARCH.format("o.created_at")} GROUP BY o.id) per_order""")
def mean_items_per_order(t, during: Days = MARCH):
    """Only lines of the month's orders are grouped; the orders are few and reach the lines first."""
    per_order = sums_by(lines_of(t.table("order_items"), t.table("orders", during)), "order_id", n=ONE)
    return per_order.agg(rounded_ratio(F.sum("n"), F.count("n")).alias("mean_items"))


@query("monthly_growth",
       """WITH months AS (SELECT date_trunc('month', created_ts) AS first, count(*) AS cnt FROM r_orders GROUP BY 1),
               before AS (SELECT m.first, max(b.first) AS earlier FROM months m LEFT JOIN months b ON b.first < m.first
                          GROUP BY m.first)
          SELECT strftime(m.first, '%Y-%m') AS mon, m.cnt, round(CAST(m.cnt AS DOUBLE) / b.cnt - 1, 6) AS growth
          FROM months m JOIN before USING (first) LEFT JOIN months b ON b.first = before.earlier""")
def monthly_growth(t):
    mon = F.date_format("created_ts", "yyyy-MM").alias("mon")
    return period_growth(t.table("orders").groupBy(mon).agg(F.count("*").alias("cnt")), "mon", "cnt")


@query("best_product_per_top_category",
       """WITH sold AS (SELECT product_id, sum(gmv) AS gmv FROM r_daily_product_metrics
                        WHERE CAST(date AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-03-31' GROUP BY product_id),
               placed AS (SELECT sold.product_id, sold.gmv, child.parent_id AS top_id, r_products.name AS product
                          FROM sold JOIN r_products ON r_products.id = sold.product_id
                          JOIN r_categories child ON child.id = r_products.category_id),
               most AS (SELECT top_id, max(gmv) AS gmv FROM placed GROUP BY top_id),
               first_of AS (SELECT placed.top_id, min(product_id) AS product_id
                            FROM placed JOIN most ON placed.top_id = most.top_id AND placed.gmv = most.gmv GROUP BY placed.top_id)
          SELECT top.id AS top_id, top.name AS category, product_id, r_products.name AS product
          FROM first_of JOIN r_categories top ON top.id = first_of.top_id JOIN r_products ON r_products.id = product_id""")
def best_product_per_top_category(t, during: Days = MARCH):
    gmv = sums_by(t.table("daily_product_metrics", during), "product_id", gmv=F.col("gmv"))
    products = products_with_path(t).select(
        F.col("id").alias("product_id"), F.col("name").alias("product"), "top_id", F.col("top").alias("category")
    )
    best = best_per_group(gmv.join(products, "product_id"), ["top_id"], [F.desc("gmv"), F.asc("product_id")])
    return best.select("top_id", "category", "product_id", "product")


@query("ordered_never_paid",
       f"""SELECT count(DISTINCT o.user_id) AS n FROM r_orders o
           WHERE {IN_MARCH.format("o.created_at")} AND NOT EXISTS (
             SELECT 1 FROM r_payments p JOIN r_orders paid ON p.order_id = paid.id
             WHERE p.status = 'success' AND paid.user_id = o.user_id)""")
def ordered_never_paid(t, during: Days = MARCH, paid_during: Days | None = None):
    """Users who ordered in a range and have no successful payment among their orders, of a period if one is given.

    Payments carry no user, so they reach one through their order.
    """
    settled = t.table("payments").where(F.col("status") == "success").select(F.col("order_id").alias("id"))
    paid_users = t.table("orders", paid_during).select("id", "user_id").join(settled, "id", "left_semi")
    buyers = t.table("orders", during).select("user_id").distinct()
    return row_count(without_match(buyers, "user_id", paid_users, "user_id"))


@query("top_sellers_by_refund_rate",
       """WITH owned AS (SELECT i.id AS line, p.seller_id AS seller_id, (i.unit_price - i.discount) * i.quantity AS sold
                         FROM r_products p JOIN r_order_items i ON i.product_id = p.id),
               sold AS (SELECT seller_id, sum(sold) AS sold FROM owned GROUP BY seller_id HAVING sum(sold) > 0),
               back AS (SELECT seller_id, sum(amount) AS refunded FROM r_refunds JOIN owned ON line = order_item_id
                        GROUP BY seller_id)
          SELECT id AS seller_id, name AS seller,
                 round(CAST(coalesce(refunded, 0) AS DOUBLE) / CAST(sold AS DOUBLE), 6) AS rate
          FROM sold LEFT JOIN back USING (seller_id) JOIN r_sellers ON id = seller_id
          ORDER BY CAST(coalesce(refunded, 0) AS DOUBLE) / CAST(sold AS DOUBLE) DESC, id LIMIT 3""")
def top_sellers_by_refund_rate(t, n: int = 3):
    """Both sums come from one pass over the lines instead of two scans per seller."""
    per_product = refunds_and_sales(t.table("order_items"), t.table("refunds"), line_amount())
    per_seller = roll_up(per_product, "product_id", t.table("products"), ["seller_id"],
                         sold=F.col("sold"), refunded=F.col("refunded"))
    sellers = t.table("sellers").select(F.col("id").alias("seller_id"), F.col("name").alias("seller"))
    rated = per_seller.where(F.col("sold") > 0).join(sellers, "seller_id").select(
        "seller_id", "seller", ratio(F.col("refunded"), F.col("sold")).alias("rate")
    )
    highest = top_n(rated, n, [F.desc("rate"), F.asc("seller_id")])
    return highest.withColumn("rate", F.round("rate", 6))


@query("active_day_runs",
       """WITH active AS (SELECT DISTINCT user_id, day FROM r_daily_user_activity
                          WHERE day >= DATE '2024-01-01' AND day < DATE '2024-02-01')
          SELECT count(*) AS runs, count(DISTINCT user_id) AS users FROM active a
          WHERE NOT EXISTS (SELECT 1 FROM active x WHERE x.user_id = a.user_id AND x.day = a.day - 1)
            AND EXISTS (SELECT 1 FROM active x WHERE x.user_id = a.user_id AND x.day = a.day + 1)
            AND EXISTS (SELECT 1 FROM active x WHERE x.user_id = a.user_id AND x.day = a.day + 2)""")
def active_day_runs(t, during: Days = JANUARY, shortest: int = 3):
    """Runs of consecutive active days, and how many users have one: two different questions."""
    runs = day_runs(t.table("daily_user_activity", during), "user_id", "day", shortest)
    per_user = runs.groupBy("user_id").agg(F.count("*").alias("runs"))
    return per_user.agg(F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"), F.count("*").alias("users"))


@query("rating_histogram",
       "SELECT rating, count(*) AS cnt FROM r_reviews WHERE rating BETWEEN 1 AND 5 GROUP BY rating")
def rating_histogram(t):
    return sums_by(t.table("reviews").where(F.col("rating").between(1, 5)), "rating", cnt=ONE)


@query("payments_by_method_two_months",
       """WITH settled AS (SELECT lower(method) AS method, date_trunc('month', paid_ts) AS mon, sum(amount) AS amt
                            FROM r_payments WHERE status = 'success' GROUP BY 1, 2),
               kinds AS (SELECT DISTINCT method FROM settled)
          SELECT kinds.method, round(CAST(j.amt AS DOUBLE), 4) AS first_amt, round(CAST(m.amt AS DOUBLE), 4) AS second_amt
          FROM kinds LEFT JOIN settled j ON j.method = kinds.method AND j.mon = DATE '1996-01-01'
                     LEFT JOIN settled m ON m.method = kinds.method AND m.mon = DATE '1996-03-01'""")
def payments_by_method_two_months(t, first: Days = month("1996-01"), second: Days = MARCH):
    """Methods without a payment in either month keep their row, so the months filter no rows."""
    paid = t.table("payments").where(F.col("status") == "success")
    amount_in = lambda during: F.sum(F.when(during.holds(F.col("paid_ts")), F.col("amount")))
    return paid.groupBy(F.lower("method").alias("method")).agg(
        as_number(amount_in(first)).alias("first_amt"), as_number(amount_in(second)).alias("second_amt")
    )


@query("cities_with_idle_user",
       """SELECT count(DISTINCT city) AS n FROM r_users u WHERE u.city IS NOT NULL AND NOT EXISTS
          (SELECT 1 FROM r_orders o WHERE o.user_id = u.id)""")
def cities_with_idle_user(t, during: Days | None = None):
    idle = without_match(t.table("users").where(F.col("city").isNotNull()), "id", t.table("orders", during), "user_id")
    return idle.agg(F.count_distinct("city").alias("n"))


@query("cities_with_idle_user_in_month",
       f"""SELECT count(DISTINCT city) AS n FROM r_users u WHERE u.city IS NOT NULL AND NOT EXISTS
           (SELECT 1 FROM r_orders o WHERE o.user_id = u.id AND {IN_MARCH.format("o.created_at")})""")
def cities_with_idle_user_in_month(t, during: Days = MARCH):
    return cities_with_idle_user(t, during)


@query("cities_without_orders",
       """SELECT count(*) AS n FROM (SELECT DISTINCT city FROM r_users WHERE city IS NOT NULL) c WHERE NOT EXISTS
          (SELECT 1 FROM r_orders o JOIN r_users u ON o.user_id = u.id WHERE u.city = c.city)""")
def cities_without_orders(t, during: Days | None = None):
    """Cities none of whose users ordered."""
    users = t.table("users").where(F.col("city").isNotNull()).select(F.col("id").alias("user_id"), "city")
    buyers = t.table("orders", during).select("user_id").distinct().withColumn("bought", F.lit(True))
    per_city = users.join(buyers, "user_id", "left").groupBy("city").agg(F.count("bought").alias("buyers"))
    return row_count(per_city.where(F.col("buyers") == 0))


@query("cities_without_orders_in_days",
       """SELECT count(*) AS n FROM (SELECT DISTINCT city FROM r_users WHERE city IS NOT NULL) c WHERE NOT EXISTS
          (SELECT 1 FROM r_orders o JOIN r_users u ON o.user_id = u.id WHERE u.city = c.city
           AND replace(substr(o.created_at, 1, 10), '/', '-') BETWEEN '1996-03-01' AND '1996-03-02')""")
def cities_without_orders_in_days(t, during: Days = days("1996-03-01", "1996-03-02")):
    return cities_without_orders(t, during)


@query("vip_level_of_largest_order",
       """SELECT u.vip_level FROM r_orders o JOIN r_users u ON o.user_id = u.id
          WHERE o.total_amount = (SELECT max(total_amount) FROM r_orders)""")
def vip_level_of_largest_order(t):
    largest = rows_at_maximum(t.table("orders").select("user_id", "total_amount"), "total_amount")
    users = t.table("users").select(F.col("id").alias("user_id"), "vip_level")
    return largest.join(users, "user_id").select("vip_level")


@query("churned_users",
       """SELECT count(DISTINCT user_id) AS n FROM r_daily_user_activity
          WHERE date = '2024-01-08' AND user_id NOT IN
            (SELECT DISTINCT user_id FROM r_daily_user_activity WHERE date = '2024-01-15')""")
def churned_users(t, before: Days = days("2024-01-08", "2024-01-08"), after: Days = days("2024-01-15", "2024-01-15")):
    active = t.table("daily_user_activity", before).select("user_id").distinct()
    return row_count(not_in(active, "user_id", t.table("daily_user_activity", after), "user_id"))


@query("buyers_by_vip_level",
       """SELECT u.vip_level, count(DISTINCT o.user_id) AS users,
                 round(CAST(sum(o.total_amount) AS DOUBLE) / count(o.total_amount), 4) AS avg_amt
          FROM r_orders o JOIN r_users u ON o.user_id = u.id GROUP BY u.vip_level""")
def buyers_by_vip_level(t):
    orders = t.table("orders")
    per_user = sums_by(orders, "user_id", amount=F.col("total_amount"), known="cast(total_amount IS NOT NULL AS int)")
    levels = per_user.join(t.table("users").select(F.col("id").alias("user_id"), "vip_level"), "user_id")
    return levels.groupBy("vip_level").agg(
        F.count("*").alias("users"), rounded_ratio(F.sum("amount"), F.sum("known"), 4).alias("avg_amt")
    )
