from __future__ import annotations

import random
from itertools import combinations

import pytest
import xxhash

from tallyfold.llm import simhash
from tests.llm.conftest import TEXTS


def brute_print(text, words=3):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    grams = [b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    value = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(prints):
    label = {key: key for key in prints}
    changed = True
    pairs = [(a, b) for a, b in combinations(prints, 2) if ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= 2]
    while changed:
        changed = False
        for a, b in pairs:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return label


def test_fingerprints_of_odd_rows(odd_docs):
    got = sorted((r.doc_id or -1, r.fp) for r in simhash.fingerprints(odd_docs).collect())
    assert got == sorted((r[0] or -1, brute_print(r[1])) for r in TEXTS)


def test_spark_hash_is_the_same(spark):
    row = spark.sql("SELECT xxhash64('one two thrée') AS h").first()
    assert row.h == int(simhash.shingle_hashes("one two thrée".encode(), 3).view("i8")[0])


@pytest.mark.parametrize("dense", [1, 64])
def test_links_connect_what_all_pairs_connect(make, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    chance, prints = random.Random(5), {}
    for base in range(40):
        value = chance.getrandbits(64)
        for _ in range(5):
            prints[len(prints)] = value
            for _ in range(chance.choice([1, 1, 2, 3])):
                value ^= 1 << chance.randrange(64)
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in prints.items()]
    classes = make("fp long, node long", [(v, k) for k, v in signed]).groupBy("fp").agg({"node": "min"}).toDF("fp", "node")
    found = {r.node: r.component for r in simhash.components(simhash.links(classes)).collect()}
    expected = brute_components(prints)
    nodes = [r.node for r in classes.collect()]
    assert {n: found.get(n, n) for n in nodes} == {n: expected[n] for n in nodes}


def test_manhattan_bound_never_exceeds_the_distance(make):
    chance = random.Random(3)
    rows = [(chance.getrandbits(63), chance.getrandbits(63)) for _ in range(200)]
    rows += [(a, a ^ 1 << chance.randrange(63)) for a, _ in rows]
    from pyspark.sql import functions as F

    frame = make("a long, b long", rows)
    bound = simhash.distance(simhash.embedded(F.col("a")), simhash.embedded(F.col("b")))
    assert frame.where(bound > simhash.distance(F.col("a"), F.col("b"))).count() == 0


def test_whole_query_against_brute_force(small):
    got = {r.doc_id: r for r in simhash.linked(small["documents"]).collect()}
    texts = {r.doc_id: r.text for r in small["documents"].collect()}
    prints = {doc_id: brute_print(text) for doc_id, text in texts.items()}
    assert {d: r.fp for d, r in got.items()} == prints
    assert {d: r.component_id for d, r in got.items()} == brute_components(prints)


def test_near_duplicates_against_brute_force(make):
    chance = random.Random(9)
    texts = {}
    for base in range(12):
        words = [chance.choice("abcdefgh") * chance.randint(1, 6) + str(chance.randrange(50)) for _ in range(chance.choice([8, 60, 300]))]
        for copy in range(base % 4 + 1):
            own = list(words)
            for _ in range(copy * len(own) // 90):
                own[chance.randrange(len(own))] = f"new{chance.random()}"
            texts[len(texts)] = " ".join(own)
    texts |= {100: None, 101: "", 102: "a b"}
    sets = {k: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, v in texts.items() for w in [(v or "").split()]}
    label = {k: k for k in texts}
    pairs = [(a, b) for a, b in combinations(texts, 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = simhash.near_duplicates(make("doc_id long, text string", list(texts.items())))
    got = {r.doc_id: r.component_id for r in found.collect()}
    assert len(pairs) > 8
    assert {k: got.get(k, k) for k in texts if sets[k]} == {k: label[k] for k in texts if sets[k]}


def edited(chance, words, times):
    own = list(words)
    for at in chance.sample(range(len(own)), times):
        own[at] = f"new{chance.random()}"
    return own


def brute_near(texts):
    words = {k: v.split() for k, v in texts.items()}
    sets = {k: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    label = {k: k for k in texts}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in combinations(texts, 2):
        shared = len(sets[a] & sets[b])
        if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
            low, high = sorted((root(a), root(b)))
            label[high] = low
    return {k: root(k) for k in texts}


def near(make, texts):
    rows = simhash.near_duplicates(make("doc_id long, text string", list(texts.items()))).collect()
    assert len(rows) == len({r.doc_id for r in rows})
    got = {r.doc_id: r.component_id for r in rows}
    return {k: got.get(k, k) for k in texts}


def test_copies_of_one_original_are_one_group(make):
    chance = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    texts = {i: " ".join(edited(chance, words, 3)) for i in range(1000)} | {5000: " ".join(words)}
    expected = brute_near(texts)
    assert len(set(expected.values())) < 20
    assert near(make, texts) == expected


@pytest.mark.parametrize("dense, members", [(64, 1 << 13), (2, 1 << 13), (2, 40)])
def test_chains_of_copies_against_brute_force(make, monkeypatch, dense, members):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "CHUNK_MEMBERS", members)
    chance, texts = random.Random(7), {}
    for group in range(3):
        chain = [[f"g{group}w{i}" for i in range(120)]]
        for _ in range(90):
            chain.append(edited(chance, chance.choice(chain), chance.choice([1, 2, 3])))
        for words in chain:
            texts[len(texts)] = " ".join(words)
    assert near(make, texts) == brute_near(texts)


def test_odd_and_empty(odd_docs, no_docs):
    assert len(simhash.linked(odd_docs).collect()) == len(TEXTS)
    assert {r.component_id for r in simhash.near_duplicates(odd_docs).collect()} <= {1, 2, 5}
    assert simhash.linked(no_docs).collect() == [] and simhash.near_duplicates(no_docs).collect() == []


def test_pipeline_drops_what_fingerprints_link(make):
    """Words that repeat outweigh those that differ: no differing bit, though the sets of shingles have little in common."""
    import corpus_pipeline

    rows = [(i, "a b c " * 400 + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(3)] + [
        (5, "some other text of its own"), (None, "a b c " * 400)]
    docs = make("doc_id long, text string", rows)
    links = {r.doc_id: r.component_id for r in simhash.linked(docs.where("doc_id IS NOT NULL")).collect()}
    assert [links[i] for i in range(3)] == [0, 0, 0] and simhash.near_duplicates(docs).collect() == []
    kept = corpus_pipeline.drop_near_copies(docs.sparkSession, docs, "").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept) == [-1, 0, 5]


def test_links_of_both_kinds_are_one_component(make, monkeypatch):
    """Fingerprint links go into the graph of near duplicates: chains over both kinds, the components found together."""
    chance = random.Random(21)
    repeated = "a b c " * 400
    words = [f"w{i}" for i in range(200)]
    rows = [(9, repeated + " ".join(f"w9x{k}" for k in range(40))), (4, repeated + " ".join(f"w4x{k}" for k in range(40)))]
    rows += [(i, " ".join(edited(chance, words, 2))) for i in (20, 21, 22)]
    rows += [(21, rows[0][1]), (30, "a text of its own with nothing in common"), (None, " ".join(words))]
    docs = make("doc_id long, text string", rows)
    calls, components = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: calls.append(1) or components(edges))
    got = {r.doc_id: r.component_id for r in simhash.all_copies(docs).collect()}
    assert got == dict.fromkeys((4, 9, 20, 21, 22), 4)
    assert len(calls) <= 1 + len(simhash.ROUNDS) + 1


def test_components_of_few_edges_run_in_few_tasks(spark, make):
    """The number of edges decides into how many tasks they go, not the number of shuffle partitions; stars need no round."""
    chance = random.Random(22)
    pairs = [(chance.randrange(300), chance.randrange(300)) for _ in range(200)] + [(1000 + i, 1000 + i + 1) for i in range(40)]
    label = {k: k for pair in pairs for k in pair}
    for _ in range(len(label)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    changed = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in changed}
    context, group = spark.sparkContext, "components-of-few-edges"
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        context.setJobGroup(group, group)
        got = {r.node: r.component for r in simhash.components(make("x long, y long", pairs)).collect()}
        stages = [context.statusTracker().getStageInfo(s) for j in context.statusTracker().getJobIdsForGroup(group)
                  for s in context.statusTracker().getJobInfo(j).stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == {k: v for k, v in label.items() if any(k in pair and pair[0] != pair[1] for pair in pairs)}
    ran = [s.numTasks for s in stages if s and s.numCompletedTasks]
    assert len(ran) > 10 and 4 * sum(n >= 60 for n in ran) < len(ran)
