from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyfold.operators.relational import not_in, roll_up, rows_at_maximum, sums_by, top_n, total_ratio, without_match
from tallyfold.operators.results import capped, run_statement
from tallyfold.operators.windows import best_per_group, day_runs, period_growth, ranked_top


def values(frame, column):
    return sorted((row[column] for row in frame.collect()), key=lambda v: (v is not None, v))


@pytest.mark.parametrize("right, kept", [([1, 2], [3]), ([1, None], []), ([], [None, 1, 3]), ([None], []), ([7], [1, 3])])
def test_not_in_follows_sql(make, right, kept):
    left = make("k int", [(1,), (3,), (None,)])
    assert values(not_in(left, "k", make("k2 int", [(v,) for v in right]), "k2"), "k") == kept


def test_without_match_keeps_null_keys(make):
    left, right = make("k int", [(1,), (None,), (2,)]), make("k int", [(1,), (1,), (None,)])
    assert values(without_match(left, "k", right, "k"), "k") == [None, 2]


def test_roll_up_equals_join_then_group(make):
    facts = make("u int, v int", [(1, 5), (1, 6), (2, 1), (3, 9), (None, 4)])
    users = make("id int, city string", [(1, "A"), (2, "A"), (4, "B"), (3, None)])
    assert sorted(map(tuple, roll_up(facts, "u", users, ["city"], s="v", n="1").collect()), key=repr) == [("A", 12, 3), (None, 9, 1)]


def test_maximum_keeps_ties(make):
    assert values(rows_at_maximum(make("id int, v int", [(1, 5), (2, 5), (3, 1), (4, None)]), "v"), "id") == [1, 2]


def test_ratio_of_empty_table_is_null(make):
    some, none = make("v int", [(4,), (None,)]), make("v int", [])
    assert total_ratio(some, F.col("v"), none, F.col("v"), "r").first()["r"] is None
    assert total_ratio(none, F.col("v"), some, F.col("v"), "r").first()["r"] is None
    assert total_ratio(some, F.col("v"), make("v int", [(0,)]), F.col("v"), "r").first()["r"] is None


def test_sum_of_missing_amounts_is_null_but_counts(make):
    row = sums_by(make("k int, v int", [(1, None), (1, None)]), "k", s="v", n="1").first()
    assert (row["s"], row["n"]) == (None, 2)


def test_ranked_top_keeps_all_ties(make):
    frame = make("id int, v int", [(1, 9), (2, 7), (3, 7), (4, 7), (5, 3), (6, 3)])
    assert sorted((row["id"], row["rk"]) for row in ranked_top(frame, "v", 3).collect()) == [(1, 1), (2, 2), (3, 2), (4, 2)]
    assert sorted(row["rk"] for row in ranked_top(frame, "v", 5).collect()) == [1, 2, 2, 2, 5, 5]
    assert sorted(row["rk"] for row in ranked_top(frame, "v", 1).collect()) == [1]


def test_best_per_group_breaks_ties_by_key(make):
    frame = make("g string, id int, v int", [("a", 2, 5), ("a", 1, 5), ("b", 3, 1)])
    assert sorted(row["id"] for row in best_per_group(frame, ["g"], [F.desc("v"), F.asc("id")]).collect()) == [1, 3]


def test_growth_first_is_null_and_zero_before_is_null(make):
    frame = make("m string, n int", [("1", 4), ("2", 6), ("3", 0), ("4", 5)])
    assert [row["growth"] for row in period_growth(frame, "m", "n").orderBy("m").collect()] == [None, 0.5, -1.0, None]


def test_runs_and_repeated_days(make):
    days = [(1, d) for d in ("2024-02-28", "2024-02-29", "2024-03-01", "2024-03-01", "2024-03-05", "2024-03-06")]
    days += [(2, d) for d in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-07", "2024-01-08", "2024-01-09", "2024-01-10")]
    found = day_runs(make("u int, d string", days), "u", "d", 3)
    assert sorted((row["u"], row["length"]) for row in found.collect()) == [(1, 3), (2, 3), (2, 4)]


def test_top_n_is_a_total_order(make):
    frame = make("k int, n int", [(3, 1), (1, 1), (2, 1)])
    assert [row["k"] for row in top_n(frame, 2, [F.desc("n"), F.asc("k")]).collect()] == [1, 2]


def test_cap_and_flag(spark):
    fifty = spark.range(50)
    rows = capped(fifty, [F.asc("id")], 10).collect()
    assert [row["id"] for row in rows] == list(range(10)) and all(row["truncated"] for row in rows)
    assert not any(row["truncated"] for row in capped(fifty, [F.asc("id")], 50).collect())
    assert capped(spark.range(0), [F.asc("id")], 10).count() == 0


def test_statements(spark, tables):
    tables.register()
    rows, more = run_statement(spark, "WITH t AS (SELECT id FROM users) SELECT id FROM t;", 10)
    assert len(rows) == 10 and more
    rows, more = run_statement(spark, "select count(*) AS n from categories")
    assert rows[0]["n"] == 30 and not more
    for refused in ("UPDATE orders SET status = 'paid'", "DROP TABLE orders", "SELECT 1; SELECT 2", "", "INSERT INTO orders VALUES (1)"):
        with pytest.raises(ValueError):
            run_statement(spark, refused)


def test_slow_statement_is_cancelled(spark):
    slow = "SELECT max(hash(a.id, b.id)) AS n FROM range(10000000) a, range(10000000) b"
    with pytest.raises(TimeoutError):
        run_statement(spark, slow, seconds=2.0)
    assert run_statement(spark, "SELECT 1 AS x")[0] == [(1,)]


def test_full_quotients_rank(make):
    from tallyfold.functions.money import ratio

    rows = make("id int, a double, b double", [(1, 0.3000001, 1.0), (2, 0.3, 1.0)])
    assert rows.orderBy(ratio(F.col("a"), F.col("b"))).first()["id"] == 2
