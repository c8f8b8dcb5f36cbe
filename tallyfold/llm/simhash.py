"""SimHash fingerprints and the documents they link.

A fingerprint of 64 bits is cut into 32 segments of two bits. The popcounts of the segments embed it in a grid of 32
axes: changing one bit moves one coordinate by one, so the Manhattan distance of two embedded points never exceeds
the Hamming distance of their fingerprints. Two fingerprints at ``RADIUS`` bits or fewer differ on at most that many
segments, so of ``RADIUS + 3`` groups of axes at least three agree entirely. The grid join therefore keys every
distinct fingerprint by the coordinates on each choice of three groups; pairs that meet are filtered by the
Manhattan bound and then by the exact distance. Popcounts are kept in thermometer code (0: 00, 1: 01, 2: 11), where
the Manhattan distance is one ``bit_count``.

Copies share a fingerprint and enter the join once. A grid cell with more than ``DENSE`` distinct fingerprints is not
expanded into pairs: its members meet at the points one flipped bit away, since two fingerprints lie within two bits
exactly if such points (or they themselves) coincide. At most 65 fingerprints meet at a point, so this is linear.

Null and empty texts have fingerprint 0 and link like any other. A text with fewer words than a shingle is one
shingle. Rows repeated with one ``doc_id`` are one document. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import checkpointed, components, forget, release, tasks_for

RADIUS = 2
DENSE = 64
SEED = 42
LOW_BITS = 0x5555555555555555
_BLOCK = 1 << 16


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words of a UTF-8 text, A-Z in lower case."""
    tokens = data.lower().split()
    if not tokens:
        return np.empty(0, "<u8")
    if len(tokens) < words:
        grams = [b" ".join(tokens)]
    else:
        grams = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(gram, SEED) for gram in grams), "<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The majority of each bit, as a signed number; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at:at + _BLOCK]
        ones += np.unpackbits(block.view("u1"), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            made = [fingerprint_of(shingle_hashes(text or b"", words)) for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        batchwise, "doc_id long, fp long")


def embedded(fp: Column) -> Column:
    """Popcounts of the two-bit segments, in thermometer code."""
    next_bit, low = F.shiftrightunsigned(fp, 1), F.lit(LOW_BITS)
    either = fp.bitwiseOR(next_bit).bitwiseAND(low)
    both = fp.bitwiseAND(next_bit).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def grid_masks() -> list[int]:
    """Signed masks of the axes that each choice of three of the groups keeps."""
    edges = np.linspace(0, 32, RADIUS + 4).round().astype(int)
    groups = [sum(3 << 2 * axis for axis in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(groups, 3)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def links(classes: DataFrame) -> DataFrame:
    """(a, b): edges between the nodes of ``classes`` (node, fp; distinct fingerprints) that connect the same
    nodes as all pairs within ``RADIUS`` bits do. As in ``components`` the number of rows decides how many tasks have them."""
    point = classes.select("node", "fp", embedded(F.col("fp")).alias("point"))
    cells = F.array(*(
        F.struct(F.lit(i).alias("axes"), F.col("point").bitwiseAND(F.lit(mask)).alias("at"))
        for i, mask in enumerate(grid_masks())))
    placed = point.withColumn("cell", F.explode(cells)).select("node", "fp", "point", "cell.axes", "cell.at")
    placed = checkpointed(placed)
    tasks = tasks_for(placed.count())
    placed = placed.coalesce(tasks)
    crowd = placed.groupBy("axes", "at").agg(F.count("*").alias("members")).where("members > 1")
    met = checkpointed(placed.join(crowd, ["axes", "at"]).coalesce(tasks))
    sparse = met.where(F.col("members") <= DENSE)
    other = sparse.select("axes", "at", *(F.col(c).alias(f"{c}_b") for c in ("node", "fp", "point")))
    pairs = (
        sparse.join(other, ["axes", "at"]).where("node < node_b")
        .where(distance(F.col("point"), F.col("point_b")) <= RADIUS)
        .where(distance(F.col("fp"), F.col("fp_b")) <= RADIUS)
        .select(F.col("node").alias("a"), F.col("node_b").alias("b")).coalesce(tasks).distinct())
    crowded = met.where(F.col("members") > DENSE).select("node", "fp").distinct().coalesce(tasks)
    near = F.concat(F.array("fp"), *(
        F.array(F.col("fp").bitwiseXOR(F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)))) for bit in range(64)))
    met_at = crowded.select("node", F.explode(near).alias("at")).groupBy("at").agg(F.collect_list("node").alias("nodes"))
    stars = met_at.where(F.size("nodes") > 1).select(
        F.explode("nodes").alias("a"), F.array_min("nodes").alias("b")).where("a <> b")
    return pairs.union(stars)


def linked(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    prints = checkpointed(fingerprints(docs, words))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(classes.where("node IS NOT NULL")))
    labelled = classes.join(found, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


def print_links(docs: DataFrame, words: int = 3) -> DataFrame:
    """(a, b): edges between doc_ids that connect what ``linked`` connects; rows without doc_id have none."""
    prints = checkpointed(fingerprints(docs.where("doc_id IS NOT NULL"), words))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    same = prints.join(classes, "fp").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    return same.union(links(classes))


#: Near duplicates: hashes per band, chance that no band finds a pair at the threshold, and bounds of a chunk.
ROWS = 3
MISSED = 1e-11
CHUNK_SHINGLES = 1 << 18
CHUNK_MEMBERS = 1 << 13
#: Last bands of the rounds in which mixed bands are compared; the last round takes all that are left.
ROUNDS = (1, 3, 9)


def bands_for(similarity: float) -> int:
    """So many bands that a pair at ``similarity`` shares none of them with a chance of ``MISSED`` at most."""
    return max(1, ceil(log(MISSED) / log1p(-min(similarity ** ROWS, 1 - 1e-9))))


def _sketches(words: int, bands: int):
    """Per row: digest of the set of shingles, fingerprint of the distinct ones, their number, and band hashes."""
    chance = np.random.default_rng(SEED)
    factors = chance.integers(0, 1 << 63, bands * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixers = chance.integers(0, 1 << 63, (ROWS, bands), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def banded(hashes: np.ndarray) -> np.ndarray:
        least = np.full(len(factors), (1 << 64) - 1, np.uint64)
        for at in range(0, len(hashes), 1024):
            np.minimum(least, (hashes[at:at + 1024, None] * factors).min(axis=0), out=least)
        least ^= least >> np.uint64(29)
        return (least.reshape(ROWS, bands) * mixers).sum(axis=0, dtype=np.uint64).view("i8")

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            keys, prints, sizes, found = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                distinct = np.unique(shingle_hashes(text or b"", words))
                keys.append(xxhash.xxh3_128_digest(distinct.tobytes()))
                prints.append(fingerprint_of(distinct))
                sizes.append(len(distinct))
                found.append(banded(distinct) if len(distinct) else distinct.view("i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(found, pa.list_(pa.int64()))], ["doc_id", "key", "fp", "n", "bands"])

    return batchwise


def _shingle_sets(words: int):
    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sets = [
                np.unique(shingle_hashes(text or b"", words))
                for text in batch.column(0).cast(pa.binary()).to_pylist()]
            keys = [xxhash.xxh3_128_digest(own.tobytes()) for own in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([own.view("i8") for own in sets], pa.list_(pa.int64()))],
                ["key", "shingles"])

    return batchwise


def joins(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Edges that connect what all pairs at ``similarity`` connect, by place; pairs of one label are connected already.

    With ``sides`` only pairs across them count. Each set in turn is compared with all that it is not yet connected to.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(sizes) - sizes
    shingles, tokens, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    labels, open_, edges = labels.copy(), np.ones(len(sets), bool), []
    for pivot in np.argsort(-np.add.reduceat(counts[tokens], starts) / sizes, kind="stable"):
        open_[pivot] = False
        other = open_ & (labels != labels[pivot])
        other &= np.minimum(sizes, sizes[pivot]) >= similarity * np.maximum(sizes, sizes[pivot])
        if sides is not None:
            other &= sides != sides[pivot]
        if not other.any():
            continue
        own = np.zeros(len(shingles), bool)
        own[tokens[starts[pivot]:starts[pivot] + sizes[pivot]]] = True
        shared = np.add.reduceat(own[tokens], starts, dtype=np.int64)
        hits = np.flatnonzero(other & (shared >= similarity * (sizes + sizes[pivot] - shared)))
        if len(hits):
            merged, first = np.unique(labels[hits], return_index=True)
            edges += [(int(pivot), int(hits[at])) for at in first]
            labels[np.isin(labels, merged)] = labels[pivot]
    return edges


def _joined_chunks(similarity: float):
    def groupwise(table: pa.Table) -> pa.Table:
        forget()
        ids = table["cid"].to_numpy()
        sets = [np.asarray(own, "i8") for own in table["shingles"].to_numpy(zero_copy_only=False)]
        _, labels = np.unique(table["component"].to_numpy(), return_inverse=True)
        across = table["low"][0].as_py() != table["high"][0].as_py()
        edges = joins(sets, labels, table["part"].to_numpy() if across else None, similarity)
        return pa.table({
            "a": pa.array([ids[a] for a, _ in edges], pa.int64()), "b": pa.array([ids[b] for _, b in edges], pa.int64())})

    return groupwise


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, also: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) of the documents that have a near copy or an edge in ``also`` (a, b; doc_ids).

    Two documents are linked when the Jaccard similarity of their shingle sets is ``similarity`` or more. At 0.8 that
    allows about ten differing bits, out of reach of the grid alone, so candidates come from two sides: fingerprints
    that the grid links, and documents with a common band, a hash of ``ROWS`` min-hashes. There are so many bands that
    a pair at the threshold has none in common with a chance of ``MISSED``. Equal sets are one class.

    First each class meets two others under a band: the one whose bands are the most common, and the one a hash puts
    first. What that connects needs no further comparison. Then the bands are gone through in ``ROUNDS``: of those that
    still hold more than one component all pairs across components are compared, as pairs where there are at most
    ``DENSE`` classes, else chunk by chunk in Arrow groups, which give a spanning forest and no row per pair. The
    components are joined before the next round, so a group is taken apart once and not once a band. The similarity is
    always computed exactly.

    Rows without doc_id take no part. Texts under one doc_id are one document. Edges in ``also`` hold without comparison.
    """
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = checkpointed(rows.mapInArrow(
        _sketches(words, bands_for(similarity)), "doc_id long, key binary, fp long, n long, bands array<long>"))
    classes = checkpointed(sketches.groupBy("key").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.any_value("fp").alias("fp"),
        F.any_value("n").alias("n"), F.any_value("bands").alias("bands")).withColumn("cid", F.monotonically_increasing_id()))
    placed = classes.select("cid", "n", F.posexplode("bands").alias("i", "band"))
    crowd = placed.groupBy("i", "band").agg(F.count("*").alias("members")).where("members > 1")
    shared = checkpointed(placed.join(crowd, ["i", "band"]))
    # Short rows from here to the components: as many tasks as their number asks for, where there are more partitions.
    tasks, few_tasks = tasks_for(shared.count()), tasks_for(classes.count())
    shared = shared.coalesce(tasks)

    close = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y)
    member = F.struct("cid", "n")
    weighed = shared.join(shared.groupBy("cid").agg(F.sum("members").alias("weight")), "cid").coalesce(tasks)
    ends = weighed.groupBy("i", "band").agg(
        F.max_by(member, F.struct("weight", "cid")).alias("hub"), F.min_by(member, F.xxhash64("cid", "band")).alias("first"))
    met = shared.join(ends, ["i", "band"]).select("cid", "n", F.explode(F.array("hub", "first")).alias("o")).where(
        close(F.col("n"), F.col("o.n"))).select(F.col("cid").alias("a"), F.col("o.cid").alias("b")).coalesce(tasks)
    by_print = checkpointed(classes.groupBy("fp").agg(F.min("cid").alias("node")))
    same = classes.join(by_print, "fp").select(F.col("cid").alias("a"), F.col("node").alias("b"))
    found = same.union(links(by_print)).union(met)
    pairs = checkpointed(found.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()).coalesce(tasks)

    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(shared.select("cid")).distinct()
    named = checkpointed(classes.select("cid", "key", "least").join(wanted, "cid", "left_semi"))
    made = rows.join(named.select(F.col("least").alias("doc_id")), "doc_id", "left_semi").select("text").mapInArrow(
        _shingle_sets(words), "key binary, shingles array<long>").dropDuplicates(["key"])
    sets = checkpointed(named.join(made, "key").select("cid", "shingles"))

    def alike(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        both = F.size(F.array_intersect("x", "y"))
        return sized.where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")

    # A doc_id with several texts is one document.
    of_doc = sketches.select("doc_id", "key").distinct().join(classes.select("key", "cid"), "key").groupBy("doc_id").agg(
        F.min("cid").alias("a"), F.max("cid").alias("b"), F.collect_set("cid").alias("all"))
    if also is not None:
        of_doc = checkpointed(of_doc)
    edges = alike(pairs).union(of_doc.where("a <> b").select("a", F.explode("all").alias("b")).where("a <> b"))
    if also is not None:
        one = lambda name: of_doc.select(F.col("doc_id").alias(name), F.col("a").alias(f"of_{name}"))
        edges = edges.union(also.toDF("a", "b").join(one("a"), "a").join(one("b"), "b").select("of_a", "of_b"))
    edges = checkpointed(edges)
    known = components(edges).toDF("cid", "component")
    known = classes.select("cid").join(known, "cid", "left").select("cid", F.coalesce("component", "cid").alias("component"))
    known = checkpointed(known.coalesce(few_tasks))
    release(docs.sparkSession)

    first = 0
    for last in (*ROUNDS, bands_for(similarity)):
        labelled = shared.where((F.col("i") >= first) & (F.col("i") < last)).join(known, "cid").coalesce(tasks)
        first = last
        mixed = labelled.groupBy("i", "band").agg(
            F.sum("n").alias("total"), F.min("component").alias("lowest"), F.max("component").alias("highest")).where(
            "lowest <> highest").drop("lowest", "highest")
        rest = checkpointed(labelled.join(mixed, ["i", "band"]).coalesce(tasks))
        if rest.isEmpty():
            continue
        sparse = rest.where(F.col("members") <= DENSE).select("i", "band", "cid", "n", "component")
        other = sparse.select("i", "band", *(F.col(c).alias(f"{c}_b") for c in ("cid", "n", "component")))
        few = sparse.join(other, ["i", "band"]).where("cid < cid_b AND component <> component_b").where(
            close(F.col("n"), F.col("n_b"))).select(F.col("cid").alias("a"), F.col("cid_b").alias("b")).coalesce(tasks).distinct()
        few = few.join(pairs, ["a", "b"], "left_anti").coalesce(tasks)
        parts = F.ceil(F.greatest(F.col("total") / CHUNK_SHINGLES, F.col("members") / CHUNK_MEMBERS))
        dense = rest.where(F.col("members") > DENSE).withColumn("parts", parts).withColumn(
            "part", F.pmod(F.xxhash64("cid", "band"), F.col("parts")))
        dense = dense.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        dense = dense.select(
            "i", "band", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "cid", "component")
        many = dense.join(sets, "cid").groupBy("i", "band", "low", "high").applyInArrow(
            _joined_chunks(similarity), "a long, b long")
        side = lambda name: known.select(F.col("cid").alias(name), F.col("component").alias(f"of_{name}"))
        joined = alike(few).union(many).join(side("a"), "a").join(side("b"), "b").select("of_a", "of_b")
        merged = components(joined).toDF("component", "merged")
        known = checkpointed(known.join(merged, "component", "left").select(
            "cid", F.coalesce("merged", "component").alias("component")).coalesce(few_tasks))
        release(docs.sparkSession)

    every = classes.select("cid", "key", "least", "most").join(known, "cid")
    every = checkpointed(every.select("key", "least", "most", "component"))
    groups = every.groupBy("component").agg(
        F.min("least").alias("component_id"), F.max("most").alias("most")).where("component_id < most").drop("most")
    grouped = every.join(groups, "component").select("key", "component_id")
    return sketches.select("doc_id", "key").join(grouped, "key").select("doc_id", "component_id").distinct()


def all_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of the documents with a copy: linked by their fingerprints (``print_links``), a link that no
    other measure overrules, or a near duplicate further away (``near_duplicates``); chains of both kinds are one
    component, found together."""
    return near_duplicates(docs, also=print_links(docs))
