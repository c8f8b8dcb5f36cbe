from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import decontamination, language_id
from tests.llm.conftest import TEXTS


@pytest.fixture(scope="module")
def model(small):
    return language_id.learned(small["documents"])


def test_held_out_documents_are_recognised(small):
    lang = {r.doc_id: r.lang for r in small["documents"].collect()}
    rows = language_id.languages(small["documents"]).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_see_only_the_text(small):
    docs = small["documents"]
    rows = docs.select("doc_id", "text", F.lit("xx").alias("lang"))
    model = language_id.learned(docs)
    told = {r.doc_id: r._language for r in language_id.predicted(docs, model).collect()}
    assert {r.doc_id: r._language for r in language_id.predicted(rows, model).collect()} == told


def brute_bits(docs, texts):
    """Code lengths by dictionaries of contexts, over bytes as they are folded; all bytes keep their own symbol."""
    fold, order = language_id.FOLD, language_id.ORDER
    counts = defaultdict(lambda: [defaultdict(Counter) for _ in range(order + 1)])
    for lang, text in docs:
        data = (b" " * order + text.encode()).translate(fold)
        for at in range(order, len(data)):
            for n in range(order + 1):
                counts[lang][n][data[at - n:at]][data[at]] += 1

    def cost(levels, data, at, size):
        value = 1.0
        for n in range(order, -1, -1):
            seen = levels[n].get(data[at - n:at])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if data[at] in seen:
                return -math.log2(value * seen[data[at]] / (total + kinds))
            value *= kinds / (total + kinds)
        return -math.log2(value / size)

    return lambda lang, text, size: sum(
        cost(counts[lang], data, at, size) for data in [(b" " * order + text.encode()).translate(fold)] for at in range(order, len(data)))


def test_code_lengths_equal_the_context_trees(make):
    docs = [("en", "the cat sat on the mat. the end"), ("en", "a cat"), ("de", "der hund und die katze"), ("fr", "le chat et la souris")]
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5][:4]
    frame = make("doc_id long, lang string, text string", [(i, *d) for i, d in zip(ids, docs, strict=True)])
    model = language_id.learned(frame)
    texts = ["the dog", "die maus", "", "zzz", "chat chat chat " * 3]
    got = language_id.bits(model, [t.encode() for t in texts])
    expected = brute_bits(docs, texts)
    for row, text in zip(got, texts, strict=True):
        for lang, value in zip(model.languages, row, strict=True):
            assert value == pytest.approx(expected(lang, text, model.size), rel=1e-4, abs=1e-3)


def test_every_byte_keeps_its_own_symbol(make):
    """Many languages that differ only in rare bytes, and a language that comes in changes no code length of another."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = [(f"l{n:02}", "ab cd " * 60 + f"{chr(0x430 + n)}{chr(0x4E00 + 97 * n)}") for n in range(40)]
    frame = make("doc_id long, lang string, text string", [(i, *d) for i, d in zip(ids, docs)])
    model = language_id.learned(frame)
    texts = [f"{chr(0x430 + n)}{chr(0x4E00 + 97 * n)}" for n in range(40)]
    got = language_id.bits(model, [t.encode() for t in texts])
    assert [model.languages[n] for n in got.argmin(axis=1)] == [lang for lang, _ in docs]
    cost = brute_bits(docs, texts)
    assert np.allclose(got, [[cost(lang, t, 256) for lang in model.languages] for t in texts], rtol=1e-4)
    fewer = language_id.bits(language_id.learned(frame.where("lang < 'l04'")), [t.encode() for t in texts])
    assert np.allclose(fewer, got[:, :4], rtol=1e-5)


def test_long_batches_are_cut_without_effect(model, monkeypatch):
    texts = [r[1].encode() if r[1] else b"" for r in TEXTS]
    whole = language_id.bits(model, texts)
    monkeypatch.setattr(language_id, "_BLOCK", 1_000)
    assert np.allclose(language_id.bits(model, texts), whole, rtol=1e-5)


def test_language_of_odd_rows(odd_docs, no_docs):
    rows = language_id.languages(odd_docs).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        text = next(t for d, t, *_ in TEXTS if d == row.doc_id)
        if not text or not any(c.isalpha() for c in text):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            assert row.lang_pred in ("en", "de", "fr", "es")
    assert language_id.languages(no_docs).collect() == []
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.languages(unlabelled).collect()} == {"und"}


ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"


def brute_align(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table))


def test_alignment_equals_the_full_table():
    chance = np.random.default_rng(3)
    for _ in range(60):
        a, b = chance.integers(1, 6, chance.integers(1, 25)), chance.integers(1, 6, chance.integers(0, 40))
        assert decontamination.align(a, b)[0] == brute_align(a.tolist(), b.tolist())


def test_copies_are_found_and_clean_documents_left(make):
    words = ITEM.split()
    filler = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor "
    edited = [w if i % 6 else "changed" for i, w in enumerate(words)]
    docs = [
        (1, filler * 30 + ITEM + " " + filler * 30), (2, filler + " ".join(edited)), (3, filler * 5), (4, " ".join(words[:5])),
        (5, ITEM.upper().replace(" ", "!! ")), (6, None), (7, ""), (8, " ".join(reversed(words))), (8, ITEM), (8, ITEM), (None, ITEM),
        (9, filler + " ".join(words[:9] + ["and", "then"] + words[9:]))]
    frame = make("doc_id long, text string, score string", [(*d, "x") for d in docs])
    items = make("item_id long, text string", [(70, ITEM), (71, None), (72, ""), (73, "short one"), (70, ITEM), (None, ITEM)])
    rows = decontamination.contaminated(frame, items).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in rows) == [(-1, 70), (1, 70), (2, 70), (5, 70), (8, 70), (9, 70)]
    assert {r.doc_id: r.score for r in rows}[1] == 1.0
    kept = decontamination.clean_rows(frame, items)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text or "")[0] for r in kept.collect()) == [3, 4, 6, 7, 8]
    assert decontamination.contaminated(frame.where("false"), items).collect() == []
    assert decontamination.contaminated(frame, items.where("false")).collect() == []


def test_blocks_of_items_give_the_same(small, monkeypatch):
    whole = sorted(map(tuple, decontamination.contaminated(small["documents"], small["benchmark"]).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2_000)
    assert sorted(r[:2] for r in map(tuple, decontamination.contaminated(small["documents"], small["benchmark"]).collect())) == [r[:2] for r in whole]
    assert whole


def test_hits_equal_aligning_everything(small):
    items = {r.item_id: r.text for r in small["benchmark"].collect()}
    texts = {r.doc_id: r.text for r in small["documents"].select("doc_id", "text").where("n_chars < 4000").collect()}
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(small["documents"], small["benchmark"]).collect()}
    vocabulary: dict[str, int] = {}
    number = lambda text: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in decontamination.words_of(text)])
    wanted = {i: number(t) for i, t in items.items()}
    for doc_id, text in list(texts.items())[:60]:
        ids = number(text)
        for item, words in wanted.items():
            score = decontamination.align(words, ids)[0]
            if score >= 2 * max(0.7 * len(words), min(len(words), decontamination.WORDS)):
                assert (doc_id, item) in found
            elif score < 0.8 * len(words):
                assert (doc_id, item) not in found
