from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyfold.operators.compare import (
    aligned_columns,
    compare_rows,
    compare_tables,
    first_mismatch,
    mismatches,
    normalized,
)


@pytest.fixture
def verdict(make):
    def run(gold_schema, gold, pred_schema, pred, **how):
        row = compare_tables(make(gold_schema, gold), make(pred_schema, pred), **how).first()
        return row["equal"], row["rule"], row["first_mismatch"]
    return run


def test_shapes_that_cannot_match(verdict):
    assert verdict("a int, b int", [(1, 2)], "x int", [(1,)]) == (False, "column_count", None)
    assert verdict("a int", [(1,), (2,)], "x int", [(1,)]) == (False, "row_count", None)
    assert verdict("a int", [(1,)], "a int, b int, c int, d int, e int", [(1, 2, 3, 4, 5)])[:2] == (True, "projection")
    assert verdict("a int", [(9,)], "a int, b int, c int, d int, e int", [(1, 2, 3, 4, 5)])[:2] == (False, "column_count")


def test_two_empty_tables_agree_whatever_their_columns(verdict):
    assert verdict("a int", [], "x string, y string", []) == (True, "both_empty", None)


def test_columns_align_by_name_else_by_place(verdict):
    gold = ("city string, orders int, share double", [("Lyon", 41, 0.25), ("Nice", 7, 0.5), ("Metz", 7, 0.125)])
    pred = [(0.125, "Metz", 7), (0.25, "Lyon", 41), (0.5, "Nice", 7)]
    assert verdict(*gold, " Share  double, CITY string, Orders int".strip(), pred)[0]
    assert not verdict(*gold, "share double, city string, n int", pred)[0]
    assert verdict("depth int", [(8,), (3,), (5,)], "level int", [(5,), (8,), (3,)])[0]
    assert verdict("depth int", [(8,), (3,), (5,)], "level int", [(5,), (9,), (3,)]) == (False, "multiset", 2)
    assert aligned_columns(["a", "A"], ["b", "a"]) == ["b", "a"]
    assert aligned_columns(["a", "b"], ["b", "c"]) == ["b", "c"]


@pytest.mark.parametrize("number", [0.0, -3.25, 812.5, 7_300_000.0, -2.5e12])
def test_tolerance_on_both_sides_of_its_edge(verdict, number):
    allowed = max(0.011, abs(number) * 1e-6)
    for sign in (-1, 1):
        assert verdict("v double", [(number,)], "v double", [(number + sign * allowed * 0.99,)])[0]
        assert not verdict("v double", [(number,)], "v double", [(number + sign * allowed * 1.02,)])[0]


@pytest.mark.parametrize("kind, values", [("int", [4, -2, 0]), ("double", [0.5, 0.0, -1.5]), ("string", ["b", "", "a"])])
def test_missing_values_agree_with_each_other_only(verdict, kind, values):
    gold = [(value,) for value in values] + [(None,), (None,)]
    assert verdict(f"v {kind}", gold, f"w {kind}", gold[::-1])[0]
    for value in values:
        assert not verdict(f"v {kind}", gold, f"w {kind}", [(None,), *gold[:-2], (value,)])[0]


def test_text_is_trimmed_and_never_equals_a_number(verdict):
    assert verdict("a string", [(" x\n",)], "a string", [("x",)])[0]
    assert not verdict("a string", [("1",)], "a int", [(1,)])[0]
    assert verdict("a string", [(None,)], "a int", [(None,)])[0]


def test_order_counts_only_when_asked_for(verdict):
    gold, pred = ("at int, v int", [(1, 1), (2, 2)]), ("at int, v int", [(1, 2), (2, 1)])
    order = [("at", True)]
    assert not verdict(*gold, *pred)[0]
    assert verdict(*gold, *pred, gold_order=order) == (False, "ordered", 0)
    assert verdict(*gold, *gold, gold_order=order) == (True, "ordered", None)


def test_order_columns_need_not_be_compared(make):
    gold = make("rank int, v int", [(1, 10), (2, 20), (3, 30)])
    pred = make("place int, w int", [(30, 10), (20, 20), (10, 30)])
    how = {"gold_columns": ["v"], "pred_columns": ["w"], "gold_order": [("rank", True)]}
    assert compare_rows(gold, pred, "ordered", pred_order=[("place", True)], **how).first()["first_mismatch"] == 0
    falling = compare_rows(gold, pred.withColumn("place", -F.col("place")), "ordered", pred_order=[("place", True)], **how)
    assert falling.first()["equal"]


def test_extra_columns_are_forgiven_when_a_choice_matches(make, verdict):
    gold = [(1, "a"), (2, "b"), (3, "a")]
    pred = [(7, "a", 3.001, "z"), (8, "b", 2.0, "z"), (9, "a", 1.0, "z")]
    assert verdict("k int, s string", gold, "id int, t string, v double, u string", pred) == (True, "projection", None)
    pred[0] = (7, "b", 3.001, "z")
    assert verdict("k int, s string", gold, "id int, t string, v double, u string", pred) == (False, "column_count", None)


def naive(gold, pred):
    """Sort both by rounded cells and compare row by row."""
    def key(row):
        rounded = tuple((c is not None, round(c, 4) if isinstance(c, float) else c) for c in row)
        raw = tuple((c is not None, c) for c in row if isinstance(c, float) or c is None)
        return rounded, raw

    def close(a, b):
        if a is None or b is None:
            return a is None and b is None
        return abs(a - b) <= max(0.011, abs(b) * 1e-6) if isinstance(a, float) else a == b

    faced = zip(sorted(gold, key=key), sorted(pred, key=key), strict=True)
    wrong = [at for at, (g, p) in enumerate(faced) if not all(map(close, g, p))]
    return wrong[0] if wrong else None


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("block", [3, 1000])
def test_positions_equal_a_naive_sort(make, seed, block):
    """Random tables with hot rows: a third of all rows is one and the same row."""
    rng = random.Random(seed)
    gold = [(rng.choice("abc"), round(rng.uniform(0, 2), 2) if rng.random() < 0.9 else None) for _ in range(80)]
    gold += [("hot", 1.0)] * 40
    pred = [(s, v if v is None else v + rng.choice([0.0, 0.003, -0.004])) for s, v in gold]
    if seed % 2:
        pred[rng.randrange(len(pred))] = ("b", 1.5)
    rng.shuffle(pred)
    schema = "s string, v double"
    found = mismatches(make(schema, gold), make(schema, pred), positions_per_block=block).agg(F.min("position")).first()[0]
    assert found == naive(gold, pred)


def test_normalized_types(make):
    frame = make("n int, b boolean, s string, d string", [(1, True, " x ", "2024-01-02")]).withColumn("d", F.col("d").cast("date"))
    assert tuple(normalized(frame).first()) == (1.0, 1.0, "x", "2024-01-02")


def test_projection_among_nine_columns(make):
    gold = make("k int, v double", [(i, i * 1.5) for i in range(6)])
    pred = make("a int, b int, c string, d double, e double, f string, g int, h double, i int", [
        (7, i * i, "x", 0.5, i * 1.5 + 0.001, None, -i, 2.5, i) for i in range(6)])
    row = compare_tables(gold, pred).first()
    assert (row["equal"], row["rule"]) == (True, "projection")


def test_first_mismatch_names_both_rows(make):
    gold = make("s string, v double", [("a", 1.0), ("b", None), ("c", 3.0), ("d", 4.0)])
    pred = make("V double, S string", [(4.0, "d"), (1.001, "a"), (2.0, "b"), (9.0, "c")])
    row = first_mismatch(gold, pred).first()
    assert (row["equal"], row["gold_rows"], row["pred_rows"], row["first_mismatch"]) == (False, 4, 4, 1)
    assert (row["gold_row"], row["pred_row"]) == ('{"s":"b","v":null}', '{"s":"b","v":2.0}')
    same = first_mismatch(gold, gold).first()
    assert tuple(same) == (True, 4, 4, None, None, None)
    assert tuple(first_mismatch(gold, gold.limit(3)).first()) == (False, 4, 3, None, None, None)
    assert tuple(first_mismatch(gold.limit(0), gold.limit(0)).first())[:3] == (True, 0, 0)
