"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of Parquet tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` how
often each query runs after one warm-up; the median counts. Results are computed in full and dropped.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyfold.plans import catalog  # noqa: E402
from tallyfold.plans.registry import run  # noqa: E402
from tallyfold.session import local_session  # noqa: E402

HEADLINE = [
    "top_cities_in_month", "top_categories_by_sales", "top_sellers_by_refund", "top_sellers_by_sales",
    "top_sellers_by_refund_rate", "top_refunded_top_categories", "top_products_by_gmv", "orders_by_status",
    "orders_per_day", "monthly_growth", "revenue_per_buyer", "vip_revenue_per_buyer", "mean_items_per_order",
    "repeat_buyer_share", "refund_rate", "ordered_never_paid", "products_never_refunded", "churned_users",
    "city_ranks", "best_product_per_top_category", "active_day_runs", "sessions_per_user_by_channel",
    "dq_parse_ts", "dq_case_variants", "dq_duplicates", "dq_price_outlier", "dq_issue_report",
    "cmp_multiset", "cmp_ordered", "cmp_projection", "m_latency", "write_summary_json",
    "l_extract_sql", "l_admit_sql", "s_bigrams", "s_topk_examples", "s_leakage_group",
]


def seconds(spark, name: str, path: str) -> float:
    start = time.perf_counter()
    run(name, spark, path).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def shuffled(spark) -> int:
    """Bytes all executors have written to shuffles so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(at).totalShuffleWrite() for at in range(executors.size()))


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = catalog.names() if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cpus, "bench")
    times, bytes_shuffled = {}, {}
    for name in names:
        before = shuffled(spark)
        seconds(spark, name, path)
        time.sleep(0.3)  # the counters are updated a little later
        bytes_shuffled[name] = shuffled(spark) - before
        times[name] = round(statistics.median(seconds(spark, name, path) for _ in range(runs)), 3)
        time.sleep(0.3)
    spark.stop()
    result = {"metric": "headline queries, warm median, total", "value": round(sum(times.values()), 3), "unit": "sec",
              "queries": times, "shuffle_bytes": bytes_shuffled, "sf": Path(path).name.removeprefix("sf"), "cpus": int(cpus), "runs": runs}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
