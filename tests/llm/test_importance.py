from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tallyfold.llm import importance
from tests.llm.conftest import TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, runs):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[at:at + n]) for n in range(1, runs + 1) for at in range(len(words) - n + 1)]


def expected(rows, target, percent=10, least_words=20, runs=1, buckets=10_000, seed=2024):
    bucket = lambda feature: zlib.crc32(feature.encode()) % buckets
    s = Counter(bucket(f) for _, text in rows for f in grams(text, runs)[1])
    t = Counter(bucket(f) for text in target for f in grams(text, runs)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    made = []
    for doc_id, text in rows:
        words, found = grams(text, runs)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        made.append([doc_id, len(found), weight, score, len(words) >= least_words])
    eligible = sorted((r for r in made if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = {id(row): at for at, row in enumerate(eligible[:percent * len(eligible) // 100], 1)}
    return sorted(((*row[:4], ranks.get(id(row))) for row in made), key=repr)


def found(docs, target, **how):
    return sorted(map(tuple, importance.resampled(docs, target, **how).collect()), key=repr)


def test_crc_matrices():
    chance = random.Random(1)
    keys = [chance.randbytes(chance.choice([0, 1, 2, 3, 7, 7, 7, 40, 3_000])) for _ in range(500)]
    assert importance.crc32s(keys).tolist() == [zlib.crc32(key) for key in keys]
    assert importance.crc32s([]).tolist() == []


def test_words():
    for _, text, *_ in TEXTS:
        assert [w.decode() for w in importance.words_of((text or "").encode())] == grams(text, 1)[0]


@pytest.mark.parametrize("runs", [1, 3])
def test_like_brute_force(make, runs):
    chance = random.Random(runs)
    words = [f"w{n}" for n in range(300)] + ["Élan", "ÀB", "漢字", "x-y", "IT's"]
    rows = [(at, " ".join(chance.choices(words, k=chance.randrange(60)))) for at in range(300)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (4, None)]
    target = [" ".join(chance.choices(words[:50], k=30)) for _ in range(20)] + [None]
    docs, aim = make("doc_id long, text string", rows).repartition(4), make("text string", [(t,) for t in target])
    assert found(docs, aim, runs=runs, percent=25) == expected(rows, target, runs=runs, percent=25)


def test_one_id_and_text_in_a_third_of_the_rows(make):
    chance = random.Random(5)
    text = " ".join(f"w{chance.randrange(50)}" for _ in range(25))
    rows = [(None, text)] * 60 + [(at, f"{text} {at}") for at in range(120)]
    docs = make("doc_id long, text string", rows).repartition(6)
    assert found(docs, make("text string", [(text,)]), percent=60) == expected(rows, [text], percent=60)


def test_blocks_do_not_matter(make, monkeypatch):
    rows = [(at, "alpha beta " * (at % 30) + f"g{at}") for at in range(100)]
    docs, aim = make("doc_id long, text string", rows), make("text string", [("alpha g1 g2",)])
    whole = found(docs, aim)
    monkeypatch.setattr(importance, "BLOCK_BYTES", 10)
    assert found(docs, aim) == whole == expected(rows, ["alpha g1 g2"])


def test_odd_rows(odd_docs, make):
    rows = [(doc_id, text) for doc_id, text, *_ in TEXTS]
    aim = make("item_id long, text string, bucket string", [(1, "the quick fox", "z"), (2, None, None)])
    assert found(odd_docs, aim, percent=100, least_words=1) == expected(rows, ["the quick fox", None], 100, 1)


def test_empty(no_docs, make):
    assert importance.resampled(no_docs, make("text string", [("a",)])).collect() == []
    rows = [(at, f"some words {at}") for at in range(30)]
    docs = make("doc_id long, text string", rows)
    assert found(docs, make("text string", []), least_words=1) == expected(rows, [], least_words=1)
    assert {r.rank for r in importance.resampled(docs, make("text string", [])).collect()} == {None}
