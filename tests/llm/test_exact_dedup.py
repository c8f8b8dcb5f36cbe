from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tallyfold.llm import exact_dedup
from tests.llm.conftest import TEXTS


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_filter_inserts_finds_and_deletes():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5_000)]
    made = exact_dedup.filled(keys, 64)
    assert made.mask + 1 > 64, "the first size must overflow"
    assert all(key in made for key in keys)
    for key in keys[:2_500]:
        made.delete(key)
    assert all(key in made for key in keys[2_500:])
    assert sum(key in made for key in keys[:2_500]) < 50


def test_false_hits_are_verified():
    bucket = exact_dedup.Bucket()
    first = bytes(8) + b"\x07\x00" + bytes(22)
    second = bytes(8) + b"\x07\x00" + b"\x01" * 22
    bucket.insert(first, 1, 5, 1)
    assert second in bucket.filter
    bucket.insert(second, 1, 5, 2)
    assert bucket.stored == {first: [1, 5, 1], second: [1, 5, 2]}


def test_bucket_grows_from_stored_digests():
    bucket, chance = exact_dedup.Bucket(), random.Random(1)
    keys = [chance.randbytes(32) for _ in range(3_000)]
    for at, key in enumerate(keys):
        bucket.insert(key, 1, 1, at)
    assert all(key in bucket.filter for key in keys) and len(bucket.stored) == 3_000


def test_odd_rows(odd_docs):
    got = exact_dedup.decisions(odd_docs).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in TEXTS:
        groups[normal(text)].append((-len(text or ""), doc_id is None, doc_id))
    assert len(got) == len(TEXTS) and sum(r.kept for r in got) == len(groups)
    by_digest = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
    for row in got:
        group = by_digest[row.text_sha256]
        assert (row.group_size, row.keep_id) == (len(group), group[0][2])


def test_kept_rows_are_the_kept_ones(odd_docs):
    rows = exact_dedup.kept_rows(odd_docs)
    assert rows.columns == odd_docs.columns
    got = [(r.doc_id, r.text) for r in rows.collect()]
    assert sorted(normal(t) for _, t in got) == sorted({normal(r[1]) for r in TEXTS})
    assert (7, TEXTS[6][1]) in got and (4, TEXTS[3][1]) in got


def test_index_takes_batches_and_deletions(make):
    rows = lambda *ids: exact_dedup.with_digests(make("doc_id long, text string", [(i, f"text {i // 2}") for i in ids]))
    index = exact_dedup.update(None, rows(0, 1, 2, 3), 3)
    index = exact_dedup.update(index, rows(4, 5, 0), 3)
    sizes = {r.keep_id: r.group_size for r in exact_dedup.live(index).collect()}
    assert sizes == {0: 3, 2: 2, 4: 2}
    index = exact_dedup.update(index, rows(2, 3, 4, 99), 3, insert=False)
    left = {(r.keep_id, r.group_size) for r in exact_dedup.live(index).collect()}
    assert left == {(0, 3), (None, 1)}


def test_next_row_is_named_after_deletions(make):
    chance = random.Random(5)
    rows = [(chance.choice([None, i]), "a" * (i % 6) + " " * chance.randrange(4)) for i in range(120)]
    gone, later = rows[::4] + rows[5::6], [(None, " a"), (500, "aa   "), (501, "b")]
    left = list(rows)
    for row in gone:
        if row in left:
            left.remove(row)
    gone = [row for row in set(rows) for _ in range(rows.count(row) - left.count(row))]
    table = lambda some: exact_dedup.with_digests(make("doc_id long, text string", some))
    index = exact_dedup.update(None, table(rows), 3)
    index = exact_dedup.update(index, table(gone), 3, insert=False)
    index = exact_dedup.update(index, table(later), 3)
    found = exact_dedup.live(exact_dedup.named(index, table(left + later), 3)).collect()
    wanted = exact_dedup.live(exact_dedup.update(None, table(left + later), 3)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, wanted), key=repr) and len(found) == 6


@pytest.mark.parametrize("made", [exact_dedup.decisions, exact_dedup.kept_rows])
def test_empty(no_docs, made):
    assert made(no_docs).collect() == []
