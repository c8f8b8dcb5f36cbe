"""The two question sets, each question as a plan with its parameters.

``answer(tables, MAIN, 64)`` runs on any source of the business tables. Numbers follow the sets.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame

from tallyfold.functions.dates import days, month
from tallyfold.plans import grouped_questions as g
from tallyfold.plans import simple_questions as s

# What the questions ask about.
MONTHS = ("2025-01", "2025-02", "2025-03")
CITIES = ("北京", "上海", "广州", "深圳", "杭州", "成都")
SELLER_CITIES = ("深圳", "杭州", "成都")
CHILD_CATEGORIES = ("耳机", "键盘", "鼠标", "充电宝", "音箱", "手环")
STATUSES = ("paid", "pending", "shipped", "cancelled")
CHANNELS = ("app_store", "douyin", "search")
CITY_LISTS = (("2025-01", 5), ("2025-02", 5), ("2025-03", 3), ("2025-03", 8), ("2025-01", 10), ("2025-02", 3))
PRODUCT_MONTHS = ((101, "2025-01"), (101, "2025-03"), (202, "2025-02"), (202, "2025-03"), (303, "2025-01"), (303, "2025-03"))
STOCK_LEVELS = (100, 1000, 3000)

JANUARY, FEBRUARY, MARCH = (month(text) for text in MONTHS)


def _each(question, name: str, values) -> list[partial]:
    return [partial(question, **{name: value}) for value in values]


def _monthly(question, months=MONTHS) -> list[partial]:
    return _each(question, "during", [month(text) for text in months])


def _numbered(*parts) -> dict[int, partial]:
    flat = [item for part in parts for item in (part if isinstance(part, list) else [part])]
    return dict(enumerate(flat, 1))


MAIN = _numbered(
    partial(s.table_size, name="orders"),
    _each(s.orders_in_status, "status", STATUSES),
    _each(s.users_in_city, "city", CITIES),
    partial(s.products_in_status, status="on_sale"),
    _monthly(s.orders_in_month),
    _each(g.products_in_category, "category", CHILD_CATEGORIES),
    _each(s.sellers_in_city, "city", SELLER_CITIES),
    s.refund_total,
    _each(s.product_rating_mean, "product", (1, 2, 3, 4)),
    partial(s.users_at_vip_level, level=3),
    _each(s.stocked_on_sale, "stock", STOCK_LEVELS),
    partial(s.coupons_of_type, kind="fixed"),
    s.default_addresses,
    s.users_without_city,
    partial(s.table_size, name="reviews"),
    s.payments_failed,
    s.price_mean,
    partial(s.vip_mean_in_city, city="上海"),
    s.stock_total,
    partial(s.table_size, name="addresses"),
    s.child_categories,
    s.seller_rating_mean,
    _monthly(s.refunds_in_month),
    partial(s.reviews_with_rating, rating=5),
    s.device_kinds,
    s.app_versions,
    partial(s.coupons_of_type, kind="percent"),
    partial(s.table_size, name="order_items"),
    s.gmv_total,
    s.coupons_redeemed,
    partial(s.default_addresses_in_city, city="北京"),
    partial(s.costly_on_sale, cost=100),
    s.refund_reasons,
    s.payment_methods,
    s.largest_order,
    s.cheapest_on_sale,
    g.orders_by_status,
    g.products_by_top_category,
    g.payments_by_method,
    [partial(g.top_cities_in_month, during=month(text), n=n) for text, n in CITY_LISTS],
    _monthly(g.top_categories_by_sales),
    [partial(g.worst_rated_products, min_reviews=10, n=n) for n in (3, 5)],
    g.top_sellers_by_refund,
    g.addresses_by_province,
    _monthly(g.orders_per_day, MONTHS[1:]),
    [partial(s.product_gmv_in_month, product=product, during=month(text)) for product, text in PRODUCT_MONTHS],
    [partial(s.channel_users, channel=channel, during=MARCH) for channel in CHANNELS],
    g.coupons_claimed,
    g.vip_revenue_per_buyer,
    g.top_reviewed_products,
    _monthly(s.mean_order_value),
    partial(g.sessions_per_device, during=MARCH),
    g.top_categories_by_price,
    g.top_sellers_by_products,
    g.top_reviewers,
    g.coupons_used_by_coupon,
    partial(g.top_channels_by_orders, during=MARCH),
    partial(g.active_users_per_day, during=MARCH),
    _monthly(g.top_refunded_top_categories),
    partial(g.repeat_users, min_orders=2),
    g.users_without_review,
    _monthly(g.revenue_per_buyer),
    _monthly(g.top_products_by_gmv),
    g.refund_rate,
    _monthly(s.order_volume),
    partial(g.idle_vips, level=2, during=MARCH),
    g.on_sale_price_by_top_category,
    partial(g.top_stock_outs, during=MARCH),
    partial(g.repeat_buyer_share, min_orders=3),
    partial(g.sessions_per_user_by_channel, during=MARCH),
)

HELD_OUT = _numbered(
    partial(s.table_size, name="products"),
    s.highest_price,
    s.coupon_users,
    partial(s.users_in_cities, cities=("北京", "上海")),
    s.orders_per_buyer,
    s.orders_without_amount,
    partial(s.reviews_with_rating, rating=5),
    partial(s.seller_rating_mean_in_city, city="杭州"),
    partial(s.payments_by_method_and_status, method="alipay", status="success"),
    s.least_stock_on_sale,
    s.unpaid_orders,
    partial(s.active_users_on_day, day="2025-03-15"),
    g.users_per_device,
    partial(g.refunds_per_day, during=FEBRUARY),
    g.products_never_refunded,
    g.top_sellers_by_sales,
    partial(s.half_month_split, during=MARCH, last_of_first="2025-03-15"),
    partial(g.city_ranks, during=MARCH, n=5),
    g.users_per_vip_level,
    s.mean_quantity,
    s.negative_orders,
    partial(g.busiest_days, during=MARCH),
    partial(s.price_mean_of_costly, cost=500),
    g.sellers_without_products,
    partial(s.users_in_two_periods, early=JANUARY, late=MARCH),
    partial(s.reviews_mentioning, text="物流"),
    g.top_categories_by_stock,
    partial(g.mean_items_per_order, during=MARCH),
    g.monthly_growth,
    partial(g.best_product_per_top_category, during=MARCH),
    partial(g.channel_spread, during=MARCH),
    partial(g.ordered_never_paid, during=MARCH, paid_during=None),
    g.top_sellers_by_refund_rate,
    partial(g.active_day_runs, during=MARCH),
    g.rating_histogram,
    partial(g.payments_by_method_two_months, first=JANUARY, second=MARCH),
    partial(g.cities_without_orders, during=None),
    g.vip_level_of_largest_order,
    partial(g.churned_users, before=days("2025-02-01", "2025-02-28"), after=MARCH),
    g.buyers_by_vip_level,
)


def answer(tables, questions: dict[int, partial], number: int) -> DataFrame:
    """One question of a set over any source of the business tables."""
    return questions[number](tables)
