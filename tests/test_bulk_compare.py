from __future__ import annotations

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import bulk_compare
from tallyfold.operators.compare import compare_tables
from tests.test_compare import naive

CELL = bulk_compare.CELL
ITEMS = "qid long, gold_columns array<string>, pred_columns array<string>, ordered boolean, error string"
ROWS = f"qid long, at long, cells array<{CELL}>"


def cell(value):
    if value is None:
        return (None, None)
    return (None, value.strip()) if isinstance(value, str) else (float(value), None)


def frames(make, pairs):
    """``pairs`` maps qid to (gold columns, gold rows, pred columns, pred rows, ordered, error)."""
    items = make(ITEMS, [(qid, p[0], p[2], p[4], p[5]) for qid, p in pairs.items()])
    side = lambda at: [(qid, i, [cell(v) for v in row]) for qid, p in pairs.items() for i, row in enumerate(p[at])]
    return items, make(ROWS, side(1)).repartition(5), make(ROWS, side(3)).repartition(3)


def agree(gold, pred, ordered):
    """Position of the first mismatch of rows of equal width, else None."""
    if not ordered:
        return naive(gold, pred)
    close = lambda a, b: a == b if a is None or b is None or isinstance(a, str) else abs(a - b) <= max(0.011, abs(b) * 1e-6)
    return next((at for at, (g, p) in enumerate(zip(gold, pred, strict=True)) if not all(map(close, g, p))), None)


def expected(gold_columns, gold, pred_columns, pred, ordered, error):
    if error is not None:
        return False, "exec_error", "exec_error", None
    if len(gold) != len(pred):
        return False, "wrong_result", "row_count", None
    if not gold:
        return True, "correct", "both_empty", None
    if len(pred_columns) > len(gold_columns):
        tried = (agree(gold, [tuple(row[at] for at in pick) for row in pred], ordered)
                 for pick in permutations(range(len(pred_columns)), len(gold_columns)))
        return (True, "correct", "projection", None) if None in tried else (False, "wrong_result", "column_count", None)
    if len(pred_columns) < len(gold_columns):
        return False, "wrong_result", "column_count", None
    names = [name.lower() for name in pred_columns]
    picks = [names.index(n.lower()) if set(names) == {g.lower() for g in gold_columns} else at for at, n in enumerate(gold_columns)]
    wrong = agree(gold, [tuple(row[at] for at in picks) for row in pred], ordered)
    return (True, "correct", "ordered" if ordered else "multiset", None) if wrong is None else (
        False, "wrong_result", "ordered" if ordered else "multiset", wrong)


def random_pair(rng):
    rows = [(rng.choice(["x", "y", "zz"]), rng.choice([None, 1.5, round(rng.uniform(0, 9), 2)])) for _ in range(rng.randrange(9))]
    rows += rows[:1] * rng.choice([0, 0, 5])
    pred = [(s, v if v is None else v + rng.choice([0, 0.004, -0.004])) for s, v in rows]
    if pred and rng.random() < 0.3:
        pred[rng.randrange(len(pred))] = ("x", 100.0)
    if pred and rng.random() < 0.15:
        pred.pop()
    ordered = rng.random() < 0.4
    if not ordered:
        rng.shuffle(pred)
    columns, gold_columns = ["S", "v"], ["s", "v"]
    if rng.random() < 0.3:
        columns, pred = ["v", "S"], [(v, s) for s, v in pred]
    if rng.random() < 0.3:
        columns, pred = [*columns, "more", "id"], [(*row, rng.choice([1.5, 2.5]), float(at)) for at, row in enumerate(pred)]
    elif rng.random() < 0.1:
        columns, pred = columns[:1], [row[:1] for row in pred]
    return gold_columns, rows, columns, pred, ordered, rng.choice([None] * 9 + ["boom " * 100])


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def labels(frames_):
    rows = bulk_compare.label_results(*frames_).collect()
    return {r["qid"]: (r["correct"], r["attribution"], r["rule"], r["first_mismatch"]) for r in rows}, rows


def test_two_hundred_pairs_in_as_many_jobs_as_two(make, spark):
    rng = random.Random(2)
    pairs = {qid: random_pair(rng) for qid in range(200)}
    some = frames(make, dict(list(pairs.items())[:2]))
    every = frames(make, pairs)
    start = jobs(spark)
    labels(some)
    few = jobs(spark) - start
    found, rows = labels(every)
    assert jobs(spark) - start - few <= few + 12, "jobs must not grow with the number of pairs"
    assert found == {qid: expected(*pair) for qid, pair in pairs.items()}
    assert {rule for _, _, rule, _ in found.values()} == {
        "exec_error", "row_count", "both_empty", "column_count", "projection", "ordered", "multiset"}
    assert all(len(r["reason"]) <= 200 and bool(r["reason"]) != r["correct"] for r in rows)


def test_like_one_comparison_after_another(make):
    rng = random.Random(8)
    pairs = {qid: (*random_pair(rng)[:4], False, None) for qid in range(8)}
    found, _ = labels(frames(make, pairs))
    for qid, (gold_columns, gold, columns, pred, *_) in pairs.items():
        schema = lambda names: ", ".join(f"{n} {'string' if n.lower() == 's' else 'double'}" for n in names)
        row = compare_tables(make(schema(gold_columns), gold), make(schema(columns), pred)).first()
        assert (row["equal"], row["rule"], row["first_mismatch"]) == (found[qid][0], found[qid][2], found[qid][3])


def test_one_question_holds_most_rows(make):
    rows = [("hot", 1.0)] * 300 + [("a", float(at)) for at in range(30)]
    pairs = {1: (["s", "v"], rows, ["s", "v"], rows[::-1], False, None), 2: (["s", "v"], [("a", 1.0)], ["s", "v"], [("a", 2.0)], False, None),
             3: (["s", "v"], rows, ["s", "v"], [*rows[:-1], ("hot", 1.5)], False, None)}
    found, _ = labels(frames(make, pairs))
    assert found == {qid: expected(*pair) for qid, pair in pairs.items()}


@pytest.mark.parametrize("wrong", [False, True])
def test_six_alike_columns_in_a_fixed_number_of_jobs(make, spark, wrong):
    """Every column holds the same values in another order, so columns alone do not tell them apart."""
    rng = random.Random(4)
    columns = [rng.sample(range(40), 40) for _ in range(6)]
    order = rng.sample(range(6), 5)
    gold = [tuple(float(columns[c][row]) for c in order) for row in range(40)]
    if wrong:
        gold[7] = (gold[7][1], gold[7][0], *gold[7][2:])
    pred = [tuple(columns[c][row] + 0.004 for c in range(6)) for row in rng.sample(range(40), 40)]
    names = lambda n: ", ".join(f"c{at} double" for at in range(n))
    frames_ = make(names(5), gold), make(names(6), pred)
    start = jobs(spark)
    row = compare_tables(*frames_).first()
    assert (row["equal"], row["rule"]) == ((False, "column_count") if wrong else (True, "projection"))
    assert jobs(spark) - start <= 60


@pytest.mark.parametrize("seed", range(3))
def test_choices_lose_no_match(make, seed):
    rng = random.Random(seed)
    width = rng.choice([3, 4])
    pred = [tuple(rng.choice([None, 0.0, 1.0, "a", "b"][at % 2::2] + [1.0 if at % 2 else "a"]) for at in range(width)) for _ in range(6)]
    pred = [(*row, row[0]) for row in pred]
    pick = rng.sample(range(width + 1), 2)
    gold = [tuple(row[at] for at in pick) for row in pred]
    pairs = {5: (["g", "h"], gold, [f"p{at}" for at in range(width + 1)], rng.sample(pred, len(pred)), False, None)}
    _, golds, preds = frames(make, pairs)
    chosen = {tuple(r["picks"]) for r in bulk_compare.column_choices(golds, preds).collect()}
    values = lambda p: sorted(repr([row[at] for at in p]) for row in pred)
    matching = [p for p in permutations(range(width + 1), 2) if values(p) == values(pick)]
    seen = lambda p: [[repr(row[at]) for row in pred] for at in p]
    for p in matching:
        assert any(seen(c) == seen(p) for c in chosen), "a match may only give way to the same columns under lower places"


def test_empty(make):
    assert bulk_compare.label_results(make(ITEMS, []), make(ROWS, []), make(ROWS, [])).collect() == []
    row = bulk_compare.label_results(make(ITEMS, [(1, ["a"], ["b", "c"], False, None)]), make(ROWS, []), make(ROWS, [])).first()
    assert (row["correct"], row["rule"], row["gold_rows"]) == (True, "both_empty", 0)
    assert bulk_compare.column_fingerprints(make(ROWS, [])).agg(F.count("*")).first()[0] == 0


def test_rows_decide_the_number_of_tasks(make, monkeypatch):
    """The rows a task sorts stay bounded however well they compress."""
    monkeypatch.setattr(bulk_compare, "ROWS_PER_TASK", 40)
    cell = lambda v: [(float(v), None)]
    gold = make(f"qid long, at long, cells array<{bulk_compare.CELL}>", [(q, i, cell(i)) for q in range(20) for i in range(20)])
    pred = make(f"qid long, at long, cells array<{bulk_compare.CELL}>", [(q, i, cell(i + 5 * (q == 3 and i == 19))) for q in range(20) for i in range(20)])
    items = make("qid long, gold_columns array<string>, pred_columns array<string>, ordered boolean, error string",
                 [(q, ["v"], ["v"], True, None) for q in range(20)])
    counts, dealt = [], type(gold).repartition
    monkeypatch.setattr(type(gold), "repartition", lambda self, n, *by: counts.append(n) or dealt(self, n, *by))
    got = {r.qid: (r.correct, r.first_mismatch) for r in bulk_compare.label_results(items, gold, pred).collect()}
    assert counts == [21, 21]
    assert got == {q: (False, 19) if q == 3 else (True, None) for q in range(20)}
