"""Single-table questions: counts, filters and global aggregates over the business tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dates import Days, day_key, days, month
from tallyfold.functions.money import as_number, rounded_ratio
from tallyfold.operators.relational import row_count
from tallyfold.plans.registry import query

MARCH = month("1996-03")


def count_where(t, table: str, condition: Column) -> DataFrame:
    """How many rows of a table meet a condition."""
    return row_count(t.table(table).where(condition))


def mean_of(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    """Exact mean: decimal or integer sum over the count of present values, divided once."""
    return df.agg(rounded_ratio(F.sum(column), F.count(column), digits).alias("mean"))


@query("table_size", "SELECT count(*) AS n FROM r_orders")
def table_size(t, name: str = "orders"):
    return row_count(t.table(name))


@query("orders_in_status", "SELECT count(*) AS n FROM r_orders WHERE lower(status) = 'paid'")
def orders_in_status(t, status: str = "paid"):
    return count_where(t, "orders", F.lower("status") == status)


@query("users_in_city", "SELECT count(*) AS n FROM r_users WHERE city = 'NATION_3'")
def users_in_city(t, city: str = "NATION_3"):
    return count_where(t, "users", F.col("city") == city)


@query("products_in_status", "SELECT count(*) AS n FROM r_products WHERE status = 'on_sale'")
def products_in_status(t, status: str = "on_sale"):
    return count_where(t, "products", F.col("status") == status)


@query("sellers_in_city", "SELECT count(*) AS n FROM r_sellers WHERE city = 'NATION_16'")
def sellers_in_city(t, city: str = "NATION_16"):
    return count_where(t, "sellers", F.col("city") == city)


@query("users_at_vip_level", "SELECT count(*) AS n FROM r_users WHERE vip_level = 3")
def users_at_vip_level(t, level: int = 3):
    return count_where(t, "users", F.col("vip_level") == level)


@query("coupons_of_type", "SELECT count(*) AS n FROM r_coupons WHERE discount_type = 'fixed'")
def coupons_of_type(t, kind: str = "fixed"):
    return count_where(t, "coupons", F.col("discount_type") == kind)


@query("default_addresses", "SELECT count(*) AS n FROM r_addresses WHERE is_default = 1")
def default_addresses(t):
    return count_where(t, "addresses", F.col("is_default") == 1)


@query("default_addresses_in_city", "SELECT count(*) AS n FROM r_addresses WHERE is_default = 1 AND city = 'NATION_2'")
def default_addresses_in_city(t, city: str = "NATION_2"):
    return count_where(t, "addresses", (F.col("is_default") == 1) & (F.col("city") == city))


@query("payments_failed", "SELECT count(*) AS n FROM r_payments WHERE status = 'failed'")
def payments_failed(t):
    return count_where(t, "payments", F.col("status") == "failed")


@query("payments_by_method_and_status",
       "SELECT count(*) AS n FROM r_payments WHERE method = 'alipay' AND status = 'success'")
def payments_by_method_and_status(t, method: str = "alipay", status: str = "success"):
    return count_where(t, "payments", (F.col("method") == method) & (F.col("status") == status))


@query("reviews_with_rating", "SELECT count(*) AS n FROM r_reviews WHERE rating = 5")
def reviews_with_rating(t, rating: int = 5):
    return count_where(t, "reviews", F.col("rating") == rating)


@query("coupons_redeemed", "SELECT count(*) AS n FROM r_user_coupons WHERE used = 1")
def coupons_redeemed(t):
    return count_where(t, "user_coupons", F.col("used") == 1)


@query("orders_in_month",
       "SELECT count(*) AS n FROM r_orders WHERE replace(substr(created_at, 1, 7), '/', '-') = '1996-03'")
def orders_in_month(t, during: Days = MARCH):
    return row_count(t.table("orders", during))


@query("refunds_in_month",
       "SELECT count(*) AS n FROM r_refunds WHERE replace(substr(refunded_at, 1, 7), '/', '-') = '1996-03'")
def refunds_in_month(t, during: Days = MARCH):
    return row_count(t.table("refunds", during))


@query("refund_total", "SELECT round(CAST(sum(amount) AS DOUBLE), 4) AS total FROM r_refunds")
def refund_total(t):
    return t.table("refunds").agg(as_number(F.sum("amount")).alias("total"))


@query("stock_total", "SELECT CAST(sum(stock) AS BIGINT) AS total FROM r_products")
def stock_total(t):
    return t.table("products").agg(F.sum("stock").alias("total"))


@query("gmv_total", "SELECT round(CAST(sum(gmv) AS DOUBLE), 4) AS total FROM r_daily_product_metrics")
def gmv_total(t):
    return t.table("daily_product_metrics").agg(as_number(F.sum("gmv")).alias("total"))


@query("product_rating_mean",
       "SELECT round(CAST(avg(rating) AS DOUBLE), 4) AS mean FROM r_reviews WHERE product_id = 3")
def product_rating_mean(t, product: int = 3):
    return mean_of(t.table("reviews").where(F.col("product_id") == product), "rating")


@query("price_mean",
       "SELECT round(CAST(sum(price) AS DOUBLE) / count(price), 4) AS mean FROM r_products")
def price_mean(t):
    return mean_of(t.table("products"), "price")


@query("vip_mean_in_city",
       "SELECT round(CAST(sum(vip_level) AS DOUBLE) / count(vip_level), 4) AS mean FROM r_users WHERE city = 'NATION_7'")
def vip_mean_in_city(t, city: str = "NATION_7"):
    return mean_of(t.table("users").where(F.col("city") == city), "vip_level")


@query("seller_rating_mean",
       "SELECT round(sum(CAST(rating AS DECIMAL(4,1))) / count(rating), 4) AS mean FROM r_sellers")
def seller_rating_mean(t, city: str | None = None):
    sellers = t.table("sellers").withColumn("rating", F.col("rating").cast("decimal(4,1)"))
    return mean_of(sellers if city is None else sellers.where(F.col("city") == city), "rating")


@query("seller_rating_mean_in_city",
       "SELECT round(sum(CAST(rating AS DECIMAL(4,1))) / count(rating), 4) AS mean FROM r_sellers WHERE city = 'NATION_16'")
def seller_rating_mean_in_city(t, city: str = "NATION_16"):
    return seller_rating_mean(t, city)


@query("mean_quantity",
       "SELECT round(CAST(sum(quantity) AS DOUBLE) / count(quantity), 4) AS mean FROM r_order_items")
def mean_quantity(t):
    return mean_of(t.table("order_items"), "quantity")


@query("price_mean_of_costly",
       "SELECT round(CAST(sum(price) AS DOUBLE) / count(price), 4) AS mean FROM r_products WHERE cost > 560")
def price_mean_of_costly(t, cost: int = 560):
    return mean_of(t.table("products").where(F.col("cost") > cost), "price")


@query("mean_order_value",
       """SELECT round(CAST(sum(total_amount) AS DOUBLE) / count(total_amount), 4) AS mean FROM r_orders
          WHERE replace(substr(created_at, 1, 7), '/', '-') = '1996-03'""")
def mean_order_value(t, during: Days = MARCH):
    return mean_of(t.table("orders", during), "total_amount")


@query("stocked_on_sale", "SELECT count(*) AS n FROM r_products WHERE stock > 3000 AND status = 'on_sale'")
def stocked_on_sale(t, stock: int = 3000):
    return count_where(t, "products", (F.col("stock") > stock) & (F.col("status") == "on_sale"))


@query("costly_on_sale", "SELECT count(*) AS n FROM r_products WHERE cost > 560 AND status = 'on_sale'")
def costly_on_sale(t, cost: int = 560):
    return count_where(t, "products", (F.col("cost") > cost) & (F.col("status") == "on_sale"))


@query("users_without_city", "SELECT count(*) AS n FROM r_users WHERE city IS NULL")
def users_without_city(t):
    return count_where(t, "users", F.col("city").isNull())


@query("child_categories", "SELECT count(*) AS n FROM r_categories WHERE parent_id IS NOT NULL")
def child_categories(t):
    return count_where(t, "categories", F.col("parent_id").isNotNull())


@query("orders_without_amount", "SELECT count(*) AS n FROM r_orders WHERE total_amount IS NULL")
def orders_without_amount(t):
    return count_where(t, "orders", F.col("total_amount").isNull())


@query("unpaid_orders", "SELECT count(*) AS n FROM r_orders WHERE pay_time IS NULL")
def unpaid_orders(t):
    return count_where(t, "orders", F.col("pay_time").isNull())


@query("negative_orders", "SELECT count(*) AS n FROM r_orders WHERE total_amount < 0")
def negative_orders(t):
    return count_where(t, "orders", F.col("total_amount") < 0)


@query("users_in_cities", "SELECT count(*) AS n FROM r_users WHERE city IN ('NATION_1', 'NATION_2')")
def users_in_cities(t, cities: tuple[str, ...] = ("NATION_1", "NATION_2")):
    return count_where(t, "users", F.col("city").isin(*cities))


@query("reviews_mentioning", "SELECT count(*) AS n FROM r_reviews WHERE content LIKE '%click%'")
def reviews_mentioning(t, text: str = "click"):
    return count_where(t, "reviews", F.col("content").contains(text))


@query("device_kinds", "SELECT count(DISTINCT device) AS n FROM r_daily_user_activity")
def device_kinds(t):
    return t.table("daily_user_activity").agg(F.count_distinct("device").alias("n"))


@query("app_versions", "SELECT count(DISTINCT app_version) AS n FROM r_daily_user_activity")
def app_versions(t):
    return t.table("daily_user_activity").agg(F.count_distinct("app_version").alias("n"))


@query("refund_reasons", "SELECT count(DISTINCT reason) AS n FROM r_refunds")
def refund_reasons(t):
    return t.table("refunds").agg(F.count_distinct("reason").alias("n"))


@query("payment_methods", "SELECT count(DISTINCT lower(method)) AS n FROM r_payments")
def payment_methods(t):
    return t.table("payments").agg(F.count_distinct(F.lower("method")).alias("n"))


@query("coupon_users", "SELECT count(DISTINCT user_id) AS n FROM r_user_coupons")
def coupon_users(t):
    return t.table("user_coupons").agg(F.count_distinct("user_id").alias("n"))


@query("active_users_on_day",
       "SELECT count(DISTINCT user_id) AS n FROM r_daily_user_activity WHERE date = '2024-01-15'")
def active_users_on_day(t, day: str = "2024-01-15"):
    return t.table("daily_user_activity", days(day, day)).agg(F.count_distinct("user_id").alias("n"))


@query("largest_order", "SELECT CAST(max(total_amount) AS DOUBLE) AS amount FROM r_orders")
def largest_order(t):
    return t.table("orders").agg(as_number(F.max("total_amount")).alias("amount"))


@query("cheapest_on_sale", "SELECT CAST(min(price) AS DOUBLE) AS price FROM r_products WHERE status = 'on_sale'")
def cheapest_on_sale(t):
    return t.table("products").where(F.col("status") == "on_sale").agg(as_number(F.min("price")).alias("price"))


@query("highest_price", "SELECT CAST(max(price) AS DOUBLE) AS price FROM r_products")
def highest_price(t):
    return t.table("products").agg(as_number(F.max("price")).alias("price"))


@query("least_stock_on_sale", "SELECT min(stock) AS stock FROM r_products WHERE status = 'on_sale'")
def least_stock_on_sale(t):
    return t.table("products").where(F.col("status") == "on_sale").agg(F.min("stock").alias("stock"))


@query("orders_per_buyer", "SELECT round(count(*) * 1.0 / count(DISTINCT user_id), 6) AS per_buyer FROM r_orders")
def orders_per_buyer(t):
    per_user = t.table("orders").groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.agg(rounded_ratio(F.sum("n"), F.count("user_id")).alias("per_buyer"))


@query("order_volume",
       """SELECT count(*) AS cnt, round(CAST(sum(total_amount) AS DOUBLE), 4) AS amt FROM r_orders
          WHERE replace(substr(created_at, 1, 7), '/', '-') = '1996-03'""")
def order_volume(t, during: Days = MARCH):
    return t.table("orders", during).agg(F.count("*").alias("cnt"), as_number(F.sum("total_amount")).alias("amt"))


@query("product_gmv_in_month",
       """SELECT round(CAST(sum(gmv) AS DOUBLE), 4) AS gmv FROM r_daily_product_metrics
          WHERE product_id = 101 AND date LIKE '1996%'""")
def product_gmv_in_month(t, product: int = 101, during: Days = days("1996-01-01", "1996-12-31")):
    metrics = t.table("daily_product_metrics", during).where(F.col("product_id") == product)
    return metrics.agg(as_number(F.sum("gmv")).alias("gmv"))


@query("channel_users",
       """SELECT count(DISTINCT user_id) AS users FROM r_daily_user_activity
          WHERE channel = 'douyin' AND date LIKE '2024-01-1%'""")
def channel_users(t, channel: str = "douyin", during: Days = days("2024-01-10", "2024-01-19")):
    active = t.table("daily_user_activity", during).where(F.col("channel") == channel)
    return active.agg(F.count_distinct("user_id").alias("users"))


@query("half_month_split",
       """SELECT CAST(sum(CASE WHEN replace(substr(created_at, 1, 10), '/', '-') <= '1996-03-15' THEN 1 ELSE 0 END)
                      AS BIGINT) AS first_half,
                 CAST(sum(CASE WHEN replace(substr(created_at, 1, 10), '/', '-') > '1996-03-15' THEN 1 ELSE 0 END)
                      AS BIGINT) AS second_half
          FROM r_orders WHERE replace(substr(created_at, 1, 7), '/', '-') = '1996-03'""")
def half_month_split(t, during: Days = MARCH, last_of_first: str = "1996-03-15"):
    day = day_key(F.col("created_at"))
    return t.table("orders", during).agg(
        F.count_if(day <= last_of_first).alias("first_half"), F.count_if(day > last_of_first).alias("second_half")
    )


@query("users_in_two_periods",
       """SELECT count(DISTINCT CASE WHEN date <= '2024-01-02' THEN user_id END) AS early_users,
                 count(DISTINCT CASE WHEN date = '2024-01-24' THEN user_id END) AS late_users
          FROM r_daily_user_activity""")
def users_in_two_periods(
    t, early: Days = days("2024-01-01", "2024-01-02"), late: Days = days("2024-01-24", "2024-01-24")
):
    """One row per user with a flag per period, then two counts: no distinct is expanded."""
    active = [
        t.table("daily_user_activity", during).select("user_id", F.lit(n == 0).alias("early"), F.lit(n == 1).alias("late"))
        for n, during in enumerate((early, late))]
    per_user = active[0].union(active[1]).groupBy("user_id").agg(F.max("early").alias("early"), F.max("late").alias("late"))
    return per_user.agg(F.count_if("early").alias("early_users"), F.count_if("late").alias("late_users"))
