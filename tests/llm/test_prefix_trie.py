from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def head_of(conv):
    return zlib.crc32(str(conv).encode()) % 9


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [t[2:] for t in sorted(turns)] for conv, turns in own.items()}
    built = {conv: own.get(conv - conv % 5, [])[:head_of(conv)] + turns[head_of(conv):] for conv, turns in own.items()}
    members = defaultdict(list)
    for conv in sorted(built):
        for depth in range(len(built[conv]) + 1):
            members[tuple(built[conv][:depth])].append(conv)
    result = []
    for path, convs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in members)
        ends = [c for c in convs if len(built[c]) == len(path)]
        result.append((
            convs[0], len(path), members[path[:-1]][0] if path else None, len(convs),
            sum(len(p) == len(path) + 1 for p in below), sum(map(leaf, below)),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(result, key=repr)


def trie(frame):
    nodes = prefix_trie.prefix_trie(frame, lambda conv: conv - conv % 5, lambda conv: F.crc32(conv.cast("string")) % 9)
    return nodes


def found(frame):
    return sorted((tuple(row)[:8] for row in trie(frame).collect()), key=repr)


def talks(n, seed):
    chance = random.Random(seed)
    says = ["hello", "how are you", "fine", "", None, "ünïcödé 漢字 😀"]
    rows = []
    for conv in chance.sample(range(0, 2 * n), n):
        rows += [(conv, turn, chance.choice(["user", "assistant", None]), chance.choice(says[:1 + turn // 2]))
                 for turn in range(chance.randrange(1, 14))]
    rows += [(rows[0][0], None, "user", "first of all"), (None, 0, "user", "nobody"), rows[3], rows[3], (rows[5][0], 2, "user", "tie")]
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_brute_force(make, seed):
    rows = talks(40, seed)
    assert found(make(SCHEMA, rows).repartition(5)) == expected(rows)


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_do_not_matter(make, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = talks(25, 7)
    assert found(make(SCHEMA, rows)) == expected(rows)


def test_one_conversation_holds_most_rows(make, spark, monkeypatch):
    """Its stretches lie in many partitions; a sixth of its rows are equal."""
    rows = [(5, turn, "user", f"turn {turn}") for turn in range(150)] + [(5, 40, "user", "again")] * 30
    rows += [(7, turn, "user", f"turn {turn}") for turn in range(12)] + [(10, 0, "user", "turn 0"), (12, 0, "x", "y")]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(prefix_trie, "SPREAD", 7)
    spark.conf.set(coalesce, "false")
    try:
        frame = make(SCHEMA, rows).repartition(6)
        own = prefix_trie.own_prefixes(prefix_trie.coded_turns(frame, 0), 0).where("conv_id = 5")
        assert sorted(r["at"] for r in own.select("at").collect()) == list(range(1, 181))
        assert found(frame) == expected(rows)
    finally:
        spark.conf.unset(coalesce)


def test_copies_of_one_conversation(make):
    rows = [(conv, turn, "user", f"t{turn}") for conv in range(0, 300, 5) for turn in range(5)]
    rows += [(conv, 0, "user", "t0") for conv in range(301, 320)]
    assert found(make(SCHEMA, rows).repartition(4)) == expected(rows)


def test_colliding_codes_are_seen_and_built_anew(make, monkeypatch):
    """Under the first seed all turns get one code."""
    real = prefix_trie.coded_turns

    def weak(frame, seed):
        turns = real(frame, seed)
        return turns if seed else turns.withColumn("code", F.lit(b"\1" * 15))

    monkeypatch.setattr(prefix_trie, "coded_turns", weak)
    rows = talks(15, 9)
    assert found(make(SCHEMA, rows)) == expected(rows)


def test_colliding_fingerprints_are_seen(make, monkeypatch):
    """With a base of 0 a fingerprint knows the last turn only."""
    real = prefix_trie.base_of
    monkeypatch.setattr(prefix_trie, "base_of", lambda seed: real(seed) if seed else 0)
    rows = talks(15, 11)
    assert found(make(SCHEMA, rows)) == expected(rows)


def test_nodes_refer_to_stored_turns(make):
    rows = talks(20, 4)
    frame = make(SCHEMA, rows)
    stored = prefix_trie.own_prefixes(prefix_trie.coded_turns(frame, 0), 0)
    nodes = trie(frame).where("depth > 0")
    joined = nodes.join(stored.select(F.col("conv_id").alias("from_conv"), F.col("at").alias("from_at")), ["from_conv", "from_at"])
    assert joined.count() == nodes.count() > 0


def test_clashing_names_and_empty(make):
    names = ["code", "print", "depth", "parent", "at", "part", "n_convs", "block"]
    rows = [(*row, *["z"] * len(names)) for row in talks(10, 5)]
    frame = make(SCHEMA + "".join(f", {name} string" for name in names), rows)
    assert found(frame) == expected([row[:4] for row in rows])
    assert found(frame.where("false")) == []
