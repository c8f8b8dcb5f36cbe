from __future__ import annotations

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.functions.dates import day_key, days, month, month_key, parse_stamp, stamp_shape
from tallyfold.operators import quality as dq
from tallyfold.operators.quantiles import group_quantiles
from tallyfold.operators.sketches import daily_sketches, distinct_in

STAMPS = {
    "2025-03-05 12:00:01": datetime(2025, 3, 5, 12, 0, 1),
    "2025/03/05 12:00": datetime(2025, 3, 5, 12, 0),
    "2025-03-05T12:00:01": datetime(2025, 3, 5, 12, 0, 1),
    "2025-03-05 23:30:00+08:00": datetime(2025, 3, 5, 23, 30),
    "2025/03/05 23:30+08:00": datetime(2025, 3, 5, 23, 30),
    "2025-03-30T02:30:00+08:00": datetime(2025, 3, 30, 2, 30),
    " 2025-03-05 12:00:01 ": datetime(2025, 3, 5, 12, 0, 1),
    "2025-02-30 12:00:00": None,
    "2025-03-05 25:00:00": None,
    "2025-3-5 12:00:00": None,
    "05.03.2025": None,
    "2025-03": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "Asia/Shanghai"])
def test_stamps_parse_on_one_wall_clock_in_any_session_zone(spark, make, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = make("text string", [(text,) for text in STAMPS])
        found = {row["text"]: row["ts"] for row in frame.withColumn("ts", parse_stamp(F.col("text"))).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found == STAMPS


def test_keys_work_on_every_shape(make):
    frame = make("text string", [(text,) for text in list(STAMPS)[:5]])
    keys = frame.select(day_key(F.col("text")).alias("d"), month_key(F.col("text")).alias("m")).distinct().collect()
    assert [(row["d"], row["m"]) for row in keys] == [("2025-03-05", "2025-03")]


def test_shapes_are_named(make):
    frame = make("text string", [("2025/03/05 12:00",), ("2025-03-05T12:00:00+08:00",), ("x",), (None,)])
    assert [row[0] for row in frame.select(stamp_shape(F.col("text"))).collect()] == ["slash", "iso_t", "other", None]


def test_ranges():
    assert (str(month("2025-12").first), str(month("2025-12").until)) == ("2025-12-01", "2026-01-01")
    assert (str(month("2024-02").until), str(days("2024-02-28", "2024-02-29").until)) == ("2024-03-01", "2024-03-01")


def test_range_end_is_outside(make):
    frame = make("text string", [("2025-03-31 23:59:59",), ("2025-04-01 00:00:00",), (None,)])
    typed = dq.parse_stamps(frame, "text")
    assert typed.where(month("2025-03").holds(F.col("text_ts"))).count() == 1


def test_case_variants_counts_per_column(make):
    frame = make("a string, b string, n int", [("paid", "x", 1), ("PAID", "y", 2), ("Paid", None, 3), ("new", "y", 4)])
    found = {row["column"]: (row["n_distinct"], row["n_lower"]) for row in dq.case_variants(frame).collect()}
    assert found == {"a": (4, 2), "b": (2, 2)}


def test_issue_report(make):
    def issues(frame):
        return sorted((row["rule"], row["column"]) for row in dq.issue_report(frame).collect())

    assert issues(make("a string, b int", [("x", None), ("X", None)])) == [("all_null", "b"), ("case_variants", "a")]
    assert issues(make("a int", [(1,), (2,)])) == []
    assert [row["rule"] for row in dq.issue_report(make("a string, b int", [])).collect()] == ["empty"]


def test_nulls_do_not_flag(make):
    frame = make("id int, v int", [(1, None), (2, -1), (3, 7), (4, 2)])
    assert [row["id"] for row in dq.negative_values(frame, "v").collect()] == [2]
    assert [row["id"] for row in dq.out_of_range(frame, "v", 0, 5).collect()] == [2, 3]


def test_precision(make):
    frame = make("v double", [(1.25,), (1.255,), (None,), (3.0,)])
    assert [row["v"] for row in dq.too_precise(frame, "v").collect()] == [1.255]


def test_orphans_ignore_null_and_count_rows(make):
    child = make("fk int", [(1,), (9,), (9,), (None,)])
    assert dq.orphans(child, "fk", make("id int", [(1,), (2,)])).collect() == [(9, 2)]


def test_duplicates_compare_null_as_equal_and_keep_first(make):
    frame = make("id int, a string, b int", [(7, "x", None), (3, "x", None), (5, "x", 1), (9, "x", None)])
    assert [(row["kept"], row["copies"]) for row in dq.duplicates(frame, "id").collect()] == [(3, 3)]


def test_bad_emails(make):
    frame = make("id int, email string", [(1, "a@x.com"), (2, "a@x.com"), (3, "b@@x.com"), (4, "c@x.com"), (5, None)])
    found = {row["email"]: (row["malformed"], row["reused"]) for row in dq.bad_emails(frame, "id", "email").collect()}
    assert found == {"a@x.com": (False, True), "b@@x.com": (True, False)}


def test_outliers_keep_the_null_group(make):
    rows = [(i, None, 10.0 + i % 5) for i in range(50)] + [(99, None, 5000.0)] + [(100 + i, 1, 5000.0 + i) for i in range(20)]
    found = dq.outliers(make("id int, g int, v double", rows), "v", "g")
    assert [row["id"] for row in found.collect()] == [99]


def test_outliers_on_both_sides_and_odd_numbers(make):
    rows = [(i, "a", 100.0 + i % 7) for i in range(70)] + [(70, "a", -50.0), (71, "a", float("inf")), (72, "a", None)]
    rows += [(73, "a", float("nan")), (74, "b", float("-inf")), (75, "c", 4.0)]
    found = dq.outliers(make("id int, g string, v double", rows), "v", "g")
    assert sorted(row["id"] for row in found.collect()) == [70, 71]
    assert dq.outliers(make("id int, g string, v double", []), "v", "g").collect() == []


def test_quantiles_are_exact_for_any_spread(make):
    chance = random.Random(3)
    values = {
        None: [chance.gauss(0, 1) * 10 ** chance.randrange(-300, 300) for _ in range(501)],
        1: [float(chance.randrange(50)) for _ in range(4000)], 2: [5e-324, 0.0, 1.5e308, -1.5e308], 3: [7.5],
        4: [1.0] * 999 + [2.0],
    }
    rows = [(g, v) for g, some in values.items() for v in some]
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    found = group_quantiles(make("g int, v double", rows), "v", "g", shares)
    got = {row["of_group"]["value"]: (row["n"], list(row["q"])) for row in found.collect()}
    assert set(got) == set(values)
    for g, some in values.items():
        assert got[g][0] == len(some)
        if g != 2:
            assert got[g][1] == pytest.approx(list(np.quantile(some, shares)), rel=1e-9)
    assert got[2][1][0] == -1.5e308 and got[2][1][-1] == 1.5e308


def test_sketches_of_days_unite(make):
    rows = [(f"2025-03-{1 + i % 9:02}", i % 700) for i in range(6300)] + [("2025-03-02", None)]
    daily = daily_sketches(make("day string, v int", rows), "day", "v")
    assert daily.count() == 9
    assert abs(distinct_in(daily).first()["estimate"] - 700) <= 21
    first = days("2025-03-01", "2025-03-03")
    wanted = len({v for d, v in rows if d <= "2025-03-03" and v is not None})
    assert abs(distinct_in(daily, first).first()["estimate"] - wanted) <= wanted * 0.03
    assert distinct_in(daily, days("2024-01-01", "2024-01-02")).first()["estimate"] == 0


def test_rows_of_a_large_group_stay_where_they_are(make):
    """Limits go to the rows: joined by the group, most rows would be sorted by one task."""
    rows = [(i, "a" if i % 10 else None, float(i % 97) if i else 1e6) for i in range(2_000)]
    found = dq.outliers(make("id int, g string, v double", rows), "v", "g")
    assert [r.id for r in found.collect()] == [0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("few, shrunk", [(0, 32), (20_000, 1), (20_000, 10**9)])
def test_quantiles_are_the_same_by_group_and_by_row(make, monkeypatch, few, shrunk):
    from tallyfold.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "SHRUNK", shrunk)
    chance, values = random.Random(5), {None: [0.0, -0.0], 1: [7.0] * 50 + [8.0], 2: []}
    values[2] = [chance.choice([-1, 1]) * 10 ** chance.uniform(-9, 9) for _ in range(500)]
    rows = [(g, v) for g, some in values.items() for v in some] + [(1, None), (1, float("nan")), (3, float("inf"))]
    found = {r.of_group.value: (r.n, r.q) for r in group_quantiles(make("g int, v double", rows), "v", "g", [0.25, 0.5]).collect()}
    assert found.keys() == values.keys()
    for g, some in values.items():
        assert found[g][0] == len(some) and found[g][1] == pytest.approx(list(np.quantile(some, [0.25, 0.5])), rel=1e-9)
