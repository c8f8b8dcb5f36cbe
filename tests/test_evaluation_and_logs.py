from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyfold.functions.text import python_round, strip
from tallyfold.operators import evaluation as ev
from tallyfold.operators.logs import admission, extract_sql, has_relative_time, known_names

LOG = ("run string, qid int, difficulty string, correct boolean, attribution string, attempts int, latency_s double, "
       "total_tokens int, llm_calls int")


def counted(rows):
    """The metrics of one run, counted in Python."""
    total, right = len(rows), [r for r in rows if r[3]]
    first = [r for r in right if r[5] <= 1]
    share = lambda part, whole: round(len(part) / whole * 100, 1) if whole else 0.0
    levels = {level: [r for r in rows if r[2] == level] for level in ("easy", "medium", "hard")}
    causes = [r[4] for r in rows if not r[3]]
    return {
        "total": total, "correct": len(right), "exec_accuracy": share(right, total), "first_round_pass": share(first, total),
        "saved_count": len(right) - len(first), "first_round_fail_count": total - len(first),
        "saved_by_correction": share(right[len(first):], total - len(first)),
        "avg_latency_s": round(sum(r[6] for r in rows) / total, 1), "avg_total_tokens": round(sum(r[7] for r in rows) / total),
        "avg_llm_calls": round(sum(r[8] for r in rows) / total, 2),
        "by_difficulty": {k: (len(v), share([r for r in v if r[3]], len(v))) for k, v in levels.items()},
        "attribution": {cause: causes.count(cause) for cause in set(causes)},
    }


@pytest.mark.parametrize("seed", range(3))
def test_summary_equals_a_count(make, seed):
    rng = random.Random(seed)
    rows = []
    for qid in range(rng.randrange(20, 60)):
        cause = rng.choice(["correct", "correct", "wrong_result", "exec_error"])
        rows.append(("r", qid, rng.choice(["easy", "hard", "hard"]), cause == "correct", cause, rng.randrange(1, 4),
                     rng.randrange(1, 400) / 8, rng.randrange(500, 3000), rng.randrange(1, 6)))
    found, wanted = ev.summaries(make(LOG, rows)).first(), counted(rows)
    assert {name: (part["total"], part["accuracy"]) for name, part in found["by_difficulty"].items()} == wanted.pop("by_difficulty")
    assert {name: found[name] for name in wanted} == wanted


def test_all_right_has_no_causes_and_saves_nothing(make):
    row = ev.summaries(make(LOG, [("r", 1, "easy", True, "correct", 1, 0.5, 10, 1)])).first()
    assert row["attribution"] == {} and row["saved_by_correction"] == 0.0


def test_empty_log_has_no_runs(make):
    assert ev.summaries(make(LOG, [])).count() == 0


def log_of(latencies):
    return [(run, i, "easy", True, "correct", 1, value, 1, 1) for run, values in latencies.items() for i, value in enumerate(values)]


@pytest.mark.parametrize("n", [1, 2, 3, 19, 20, 21, 40])
def test_percentile_index(make, n):
    values = [round(7.5 * (at * 13 % n) + 0.25, 2) for at in range(n)]
    row = ev.latency_percentiles(make(LOG, log_of({"r": values}))).first()
    wanted = [sorted(values)[min(int(n * share), n - 1)] for share in (0.5, 0.95)]
    assert [row["p50_latency_s"], row["p95_latency_s"]] == wanted


def test_percentiles_of_skewed_runs(make):
    """One value holds most rows of one run; values share a bucket without being equal."""
    rng = random.Random(5)
    latencies = {"hot": [1.5] * 300 + [rng.uniform(0, 3) for _ in range(100)], "one": [0.25],
                 "close": [2.0 + i * 1e-5 for i in range(60)], "closer": [2.0 + i * 1e-8 for i in range(70)] * 2,
             "far": [rng.uniform(0, 1e5) for _ in range(50)]}
    wanted = {"p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = {row["run"]: row for row in ev.latency_percentiles(make(LOG, log_of(latencies)), **wanted).collect()}
    for run, values in latencies.items():
        ordered = sorted(values)
        for name, share in wanted.items():
            assert found[run][f"{name}_latency_s"] == ordered[min(int(len(ordered) * share), len(ordered) - 1)]


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_rounding_is_that_of_python(make, digits):
    rng = random.Random(digits)
    numbers = [12.35, 12.25, 2.45, 0.05, 2.5, 3.5, 1234567.25, 0.0, 99.95] + [rng.randrange(1, 5000) / 8 for _ in range(200)]
    numbers += [n / d * 100 for n in range(1, 40) for d in (40, 160, 2000)]
    frame = make("v double", [(n,) for n in numbers]).select("v", python_round(F.col("v"), digits).alias("r"))
    assert all(row["r"] == round(row["v"], digits) for row in frame.collect())


def test_ablation(make):
    frame = make("run string, acc double", [("base", 70.0), ("hints", 87.5), ("few", 65.0)])
    found = {row["run"]: row["acc_delta"] for row in ev.ablation(frame, "base", "acc").collect()}
    assert found == {"base": 0.0, "hints": 17.5, "few": -5.0}


def test_item_faults(make):
    items = make("id int, question string, difficulty string, gold_sql string", [
        (1, "a", "easy", "SELECT 1"), (1, "b", "easy", "WITH t AS (SELECT 1) SELECT 1"), (2, "b", "hard", "DROP TABLE t")])
    found = ev.item_violations(items, {"easy": 2, "hard": 2}, admission(F.col("gold_sql")))
    assert sorted(map(tuple, found.collect())) == [
        ("level_count", "hard", 1), ("not_admitted", "not_a_query", 1), ("repeated_id", "1", 2), ("repeated_question", "b", 2)]


def column_of(make, texts, expression):
    frame = make("at int, text string", list(enumerate(texts)))
    return [row["out"] for row in frame.select("at", expression(F.col("text")).alias("out")).orderBy("at").collect()]


def test_admission(make):
    texts = ["UPDATE t SET a = 1", "DROP TABLE t", "PRAGMA x", "ATTACH 'x' AS y", "INSERT INTO t VALUES (1)", "SELECT 1; SELECT 2",
             "", " ;; ", "select 1", "WITH t AS (SELECT 1 AS x) SELECT x FROM t;", "SELECT ';'", "SELECTED"]
    refused, many, empty, fine = "not_a_query", "many_statements", "empty", "ok"
    assert column_of(make, texts, admission) == [refused] * 5 + [many, empty, empty, fine, fine, many, refused]


def test_extraction(make):
    texts = ["```sql\nSELECT 1;\n```", "so: ```\nSELECT 2\n``` and ```sql\nSELECT 3\n```", "  SELECT 4 ; ", "```SELECT\n5```", "", "``` ```"]
    assert column_of(make, texts, extract_sql) == ["SELECT 1", "SELECT 2", "SELECT 4", "SELECT\n5", "", ""]


def test_relative_time(make):
    texts = ["上个月的订单", "近30天", "2025-03 月的订单", "截止目前", ""]
    assert column_of(make, texts, has_relative_time) == [True, True, False, True, False]


def test_table_lists(make):
    texts = ["orders, users", "users，bogus；orders\nusers", "  ", "none"]
    found = column_of(make, texts, lambda text: known_names(text, ["orders", "users"]))
    assert found == [["orders", "users"], ["users", "orders", "users"], [], []]


def test_strip_is_that_of_python(make):
    texts = ["", "  ", "\t a b \n", "　退款 ", "\x1c\x85x ", "x", "\r\n; "]
    assert column_of(make, texts, strip) == [text.strip() for text in texts]


def test_listed_runs_without_rows_are_zero(make):
    log = make("run string, correct boolean, attempts int, latency_s double, total_tokens int, llm_calls int", [("a", True, 1, 1.0, 1, 1)])
    for rows, expected in ((log, {"a": (1, 1, 100.0), "b": (0, 0, 0.0)}), (log.where("false"), {"a": (0, 0, 0.0), "b": (0, 0, 0.0)})):
        got = ev.exec_accuracy(rows, make("run string", [("a",), ("b",)]))
        assert {r["run"]: (r["total"], r["correct"], r["exec_accuracy"]) for r in got.collect()} == expected


@pytest.mark.parametrize("space", ["\u3000", "\u00a0"])
def test_white_space_of_any_script(make, space):
    texts = make("t string", [(f"orders{space}users",), (f"SELECT{space} 1",), (f"```sql{space}SELECT 2{space}```",)])
    row = texts.agg(
        F.max(F.array_join(known_names(F.col("t"), ["orders", "users"]), ",")).alias("names"),
        F.max_by(admission(F.col("t")), F.col("t").startswith("SELECT")).alias("reason"),
        F.max_by(extract_sql(F.col("t")), F.col("t").startswith("```")).alias("sql")).first()
    assert (row["names"], row["reason"], row["sql"]) == ("orders,users", "ok", "SELECT 2")
