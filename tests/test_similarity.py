from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyfold.functions.text import jaccard, ngrams
from tallyfold.operators import similarity as sim
from tallyfold.operators.similarity import best_examples, leakage_groups, similar_pairs


def grams(text, n=2):
    return {text[i:i + n] for i in range(len(text) - n + 1)}


def similarity(a, b, n=2):
    left, right = grams(a, n), grams(b, n)
    return len(left & right) / len(left | right) if left and right else 0.0


@pytest.fixture(scope="module")
def texts():
    """Random words with exact copies of one text making up a third of all."""
    rng = random.Random(11)
    words = ["order", "refund", "city", "sales", "top", "用户", "退款", "é", "😀x", "\n"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    return made + ["refund top city sales"] * 30 + ["", "x"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams(make, texts, n):
    frame = make("text string", [(text,) for text in texts]).select("text", ngrams(F.col("text"), n).alias("grams"))
    for row in frame.collect():
        assert len(row["grams"]) == len(set(row["grams"])) and set(row["grams"]) == grams(row["text"], n)


def test_jaccard_ends(make):
    pairs = make("a string, b string", [("退款金额", "退款金额"), ("", "任意"), ("x", "x"), ("ab", "cd")])
    scores = pairs.select(jaccard(ngrams(F.col("a")), ngrams(F.col("b")))).collect()
    assert [row[0] for row in scores] == [1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("threshold", [0.05, 0.35, 0.5, 0.8, 1.0])
@pytest.mark.parametrize("n", [2, 3])
def test_pairs_equal_brute_force(make, texts, threshold, n):
    others = texts[10:40] + ["refund top city", "sales"]
    left = make("id int, text string", list(enumerate(texts)))
    right = make("other int, text string", list(enumerate(others)))
    found = {(row["id"], row["other"]): row["score"] for row in similar_pairs(left, right, "id", "other", threshold, n).collect()}
    wanted = {(i, j): similarity(a, b, n) for i, a in enumerate(texts) for j, b in enumerate(others)}
    assert found == {pair: score for pair, score in wanted.items() if score >= threshold}


EXAMPLES = [(0, "refund top city sales", "refund 退款"), (1, "order order city", None), (2, "refund top city sales", "order"), (3, "用户 用户 top", "  ")]


@pytest.mark.parametrize("block_characters", [1_000_000, 100])
def test_best_examples_either_way(make, texts, block_characters):
    questions = make("id int, text string", list(enumerate(texts)))
    examples = make("ordinal int, question string, keywords string", EXAMPLES)
    found: dict[int, list] = {}
    for row in best_examples(questions, examples, "id", block_characters=block_characters).orderBy("id", "place").collect():
        found.setdefault(row["id"], []).append((row["ordinal"], round(row["score"], 9)))
    wanted = {}
    for at, text in enumerate(texts):
        scored = [(max([similarity(text, q), *(similarity(text, w) for w in (k or "").split())]), o) for o, q, k in EXAMPLES]
        best = sorted((pair for pair in scored if pair[0] >= 0.15), key=lambda pair: (-pair[0], pair[1]))[:2]
        if best:
            wanted[at] = [(o, round(s, 9)) for s, o in best]
    assert found == wanted


@pytest.mark.parametrize("block_characters", [1_000_000, 100])
def test_leakage_either_way(make, texts, block_characters):
    items = make("id int, text string", [*enumerate(texts), (999, None)])
    examples = make("text string", [(q,) for _, q, _ in EXAMPLES] + [("",)])
    found = {row["id"]: (row["leakage"], row["similarity"]) for row in
             leakage_groups(items, examples, "id", block_characters=block_characters).collect()}
    assert found.pop(999) == ("clean", None)
    for at, text in enumerate(texts):
        best = max(similarity(text, q) for _, q, _ in EXAMPLES)
        assert found[at] == (("leaked", best) if best >= 0.35 else ("clean", None))


def test_unrelated_question_gets_nothing(make):
    questions = make("id int, text string", [(1, "zzzz qqqq")])
    examples = make("ordinal int, question string, keywords string", EXAMPLES)
    assert best_examples(questions, examples, "id").count() == 0
    assert best_examples(questions, examples.limit(0), "id").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6])
def test_scores_in_arrays(texts, n, monkeypatch):
    """Texts beyond the basic plane, repeated and empty ones, and characters that a fixed width could lose."""
    strings = [*texts[:25], "a\0b\0", "\0\0\0a", "", "😀😀😀x"]
    asked = [*texts[20:50], None, "a\0b", "\0\0\0\0a"]
    monkeypatch.setattr(sim, "CELLS", 60)
    found = [row for _, scores in sim.Index(strings, n).in_parts(asked) for row in scores.tolist()]
    assert found == [[similarity(a or "", b, n) for b in strings] for a in asked]
    assert sim.Index([], n).scores(asked).shape == (len(asked), 0)


def test_nothing_is_collected_and_no_row_per_pair(make, texts, monkeypatch):
    """Sizes come to the driver, two rows; what tasks pass on is at most k rows for each text and block."""
    questions = make("id int, text string", list(enumerate(texts * 4)))
    examples = make("ordinal int, question string, keywords string", [(at, text, text) for at, text in enumerate(texts)])
    best = sim.best_of_blocks(questions, sim.example_strings(examples), "text", 2, 0.0, 2, 300)
    best.collect()
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "FlatMapCoGroupsInArrow" in plan
    assert best.count() == len(set(texts))
    rows = best_examples(questions, examples, "id", lowest=0.0).groupBy("id").count().collect()
    assert len(rows) == 4 * len(texts) and {row["count"] for row in rows} == {2}
