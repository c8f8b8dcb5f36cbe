from __future__ import annotations

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tallyfold.llm import packing, token_counts
from tests.llm.conftest import TEXTS

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    "  two  spaces ", "\n\n", " ", "▁▁a ▁b", "tab\tand\x0bmore\xa0space", "<s> </s> <unk> <0x0A>", "a\n b\n\n c", "É é ́x",
    "don't DON'T it's 'tis 's rock'n'roll", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "x\x1cy\x85z", "12,345.67 v2.0!",
    "ŸÉÎ ẞ İ K Å Ω", "word,,, ...word (word) [w] {w}_w", "ſtraße", "漢字かな", "😀😀 🏳️‍🌈", "a" * 3_000,
]


@pytest.mark.parametrize("head", [0, 50, 10_000])
def test_token_counts_equal_the_librarys(odd_docs, small, make, head):
    model = SentencePieceProcessor(model_file=PIECES)
    awkward = make("doc_id long, text string", list(enumerate(AWKWARD)))
    for docs in (odd_docs, small["documents"], awkward):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, PIECES, head).collect())
        texts = [(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        assert got == sorted((d, len(t.encode()), len(model.encode(t))) for d, t in texts)


def test_rows_without_id_whose_short_hashes_collide(spark, make):
    """Texts that one 32-bit hash takes for equal keep their own counts."""
    words = spark.range(500_000).select(F.concat(F.lit("w"), F.repeat(F.lit(" x"), (F.col("id") % 4).cast("int")), F.col("id").cast("string")).alias("text"))
    pairs = words.groupBy(F.hash("text")).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").limit(5).collect()
    texts = [text for row in pairs for text in row.texts] * 2
    assert len(texts) >= 20
    model = SentencePieceProcessor(model_file=PIECES)
    for head in (0, 1_000):
        got = token_counts.token_counts(make("doc_id long, text string", [(None, text) for text in texts]), PIECES, head).collect()
        assert sorted((r.n_bytes, r.n_tokens) for r in got) == sorted((len(t), len(model.encode(t))) for t in texts)


def test_distinct_pre_tokens_are_kept_in_few_bytes(spark):
    """As a checkpoint the table took some 80 bytes for each of them, most of the disk beside the shuffles."""
    held = lambda: sum(file.stat().st_size for file in Path(spark.conf.get("spark.checkpoint.dir")).rglob("*") if file.is_file())
    words = F.concat_ws(" ", *(F.concat(F.lit("w"), (F.col("id") * 20 + at).cast("string")) for at in range(20)))
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), words.alias("text"))
    before = held()
    counts = token_counts.token_counts(docs, PIECES)
    assert 0 < held() - before < 40_000 * 20
    assert counts.count() == 2_000


def test_empty_tables(no_docs):
    assert token_counts.token_counts(no_docs, PIECES).collect() == []
    assert packing.packed(no_docs, WORDS).collect() == []


def test_word_ids_equal_the_librarys(small):
    tokenizer, ids = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    for text in [*AWKWARD, *(r[1] or "" for r in TEXTS), *(r.text for r in small["documents"].select("text").limit(60).collect())]:
        for _ in range(2):
            got = np.frombuffer(ids.of(text, b""), ids.dtype).tolist()
            assert got == tokenizer.encode(text, add_special_tokens=False).ids, text[:60]


def check_layout(rows, docs, length):
    tokenizer = Tokenizer.from_file(WORDS)
    expected = defaultdict(list)
    for row in docs.select("doc_id", "text").collect():
        expected[row.doc_id].append(np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces, sequences, total = defaultdict(list), defaultdict(list), 0
    for row in rows:
        pieces[row.doc_id, row.doc_tokens].append((row.start, row.length, row.ids_crc32))
        sequences[row.sequence_id].append((row.offset, row.length))
        total += row.length
    assert total == sum(len(ids) for many in expected.values() for ids in many)
    for doc_id, many in expected.items():
        crcs = sorted(p for ids in many for p in pieces[doc_id, len(ids)])
        for ids in many:
            for start, n, crc in pieces[doc_id, len(ids)]:
                options = {zlib.crc32(other[start:start + n].tobytes()) for other in many if len(other) == len(ids)}
                assert crc in options
        assert sum(n for _, n, _ in set(crcs)) <= sum(n for _, n, _ in crcs)
    for number, parts in sequences.items():
        position = 0
        for offset, n in sorted(parts):
            assert offset == position
            position += n
        assert position == length or number == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("block_tokens, length", [(1 << 19, 2048), (5_000, 128)])
def test_every_id_lies_in_one_piece(odd_docs, small, monkeypatch, block_tokens, length):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", block_tokens)
    monkeypatch.setattr(packing, "BLOCKS_SUMMED", 4)
    for docs in (odd_docs, small["documents"]):
        check_layout(packing.packed(docs, WORDS, length, quantum=32).collect(), docs, length)


def test_ids_of_pieces_and_row_order(small):
    rows = packing.packed(small["documents"], WORDS, with_ids=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def test_windows_follow_the_mixture_and_carry_deficits():
    queues = [packing.Queue(0.25, 120.0), packing.Queue(0.75, -120.0)]
    for at in range(400):
        queues[at % 4 != 0].add(at, bytes(4 * 99))
    share = defaultdict(int)
    for position, piece in packing.served(queues, 500, 1_000, 50):
        share[position // 1_000, piece[0] % 4 == 0] += piece[2]
    assert abs(share[0, True] - (125 + 120)) <= 50, "the first window makes up for what was carried in"
    assert all(abs(share[n, True] - 250) <= 50 for n in range(1, 38))
    assert abs(sum(share[n, True] for n in range(30)) - (0.25 * 29_500 + 120)) <= 50


def test_any_mixture_uses_every_id(make, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 3_000)
    docs = make("doc_id long, text string, source string", [(i, "word " * 99, "ab"[i % 4 == 0]) for i in range(100)])
    for mixture in ({"a": 0.5, "b": 0.5}, {"b": 1.0}, {}):
        check_layout(packing.packed(docs, WORDS, 1_000, quantum=50, mixture=mixture).collect(), docs, 1_000)


@pytest.mark.parametrize("text", [lambda i: "", lambda i: "word " * 99, lambda i: f"text {i} " * 40])
@pytest.mark.parametrize("key", [None, 7])
def test_rows_that_share_or_lack_an_id_are_spread(make, monkeypatch, text, key):
    """A third of all rows has no doc_id or the same one; copies of one text with the same id are one key."""
    if key is not None and text(1) == text(2):
        pytest.skip("rows that are equal in every way")
    sizes = []
    plain = packing.dealt
    monkeypatch.setattr(packing, "BLOCK_TOKENS", 16_384)
    monkeypatch.setattr(packing, "dealt", lambda tokens, blocks: sizes.append(
        [r[1] for r in plain(tokens, blocks).groupBy("block").sum("n").collect()]) or plain(tokens, blocks))
    docs = make("doc_id long, text string, source string", [
        (key if i % 3 == 0 else i, text(i) if i % 3 == 0 else f"word {i} " * 50, "ab"[i % 2]) for i in range(3_000)])
    rows = packing.packed(docs, WORDS, 1_000).collect()
    assert sum(r.length for r in rows) == sum(sizes[0]) and sum(r.doc_tokens for r in rows if r.start == 0) == sum(sizes[0])
    place = 0
    for row in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert row.sequence_id * 1_000 + row.offset == place
        place += row.length
    assert len(sizes[0]) > 5 and max(sizes[0]) < 2 * 16_384
