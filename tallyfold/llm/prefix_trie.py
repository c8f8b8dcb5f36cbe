"""The prefix trie of rebuilt conversations, from composable fingerprints.

A conversation is rebuilt from the first turns of its base conversation (the head) and its own turns behind that number
(the suffix). Sequences of turns map to a monoid: a sequence of n turns has the product ``h`` with
``h(xy) = h(x) * BASE**len(y) + h(y)`` modulo a prime of 127 bits, so the fingerprint of a rebuilt prefix is put together
from three stored products, that of the base's head and those of the own turns up to two places. No rebuilt text and no
rebuilt list of turns is made: a rebuilt turn is a row with its depth, its fingerprint and a reference (conversation and
place) to the stored turn it comes from.

Equality is verified, not trusted. A turn's own code is a digest of role and text, and turns of one code must have one
role and one text. Members of one fingerprint at one depth must have one code of the last turn and one fingerprint
before it; by induction their sequences are equal. Where a check fails everything is built again under the next seed.

How it stays distributed: turns are range-partitioned by conversation and place (repeated turns are spread over
several partitions), every partition multiplies its stretch, and the products before a partition reach it through
a table with one row for each conversation that crosses a border of partitions. A trie node is a group with partial
counts. Sums over subtrees use chains: every node belongs to its smallest member, whose own rebuilt path passes all
ancestors, so a node's sum is a sum of suffix sums over the paths of the members that own nodes, one row per rebuilt turn.
Suffix sums run in blocks of ``BLOCK`` turns. The ids of the members that end at a node are joined in blocks of ``BLOCK``
ids and hashed as a stream, so not even the ids of a third of all conversations are held at once.

Rows without conv_id belong to no conversation. Null role and text are empty. Turns come in the order of ``turn``, null
first, then role and text. Repeated rows are turns of their own. Turnless rebuilt conversations end at the root. An empty
table has no conversation and so not even a root: the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import checkpointed

PRIME = (1 << 127) - 1
BLOCK = 1024
SPREAD = 64
ROOT = bytes(16)
NOTHING = hashlib.sha256(b"").hexdigest()


def base_of(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"base {seed}".encode()).digest()[:15], "big") | 1


def _number(data: bytes) -> int:
    return int.from_bytes(data, "big")


def _stored(number: int) -> bytes:
    return number.to_bytes(16, "big")


def coded_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, turn, role, text, code): code is a digest of role and text."""
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    whole = F.concat(F.lit(f"{seed}:"), F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
        F.substring(F.unhex(F.sha2(whole, 256)), 1, 15).alias("code"))


def _products(base: int):
    """Per turn of a sorted partition: its place in the partition's stretch of the conversation, and that stretch's product."""

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, product = None, 0, 0
        for batch in batches:
            places, products, before = [], [], []
            for conv, code in zip(batch["conv_id"].to_pylist(), batch["code"].to_pylist(), strict=True):
                if conv != current:
                    current, place, product = conv, 0, 0
                before.append(_stored(product))
                place, product = place + 1, (product * base + _number(code) + 1) % PRIME
                places.append(place)
                products.append(_stored(product))
            yield pa.RecordBatch.from_arrays(
                [*(batch[name] for name in ("conv_id", "part", "code", "n_bytes")), pa.array(places, pa.int64()),
                 pa.array(products, pa.binary()), pa.array(before, pa.binary())],
                ["conv_id", "part", "code", "n_bytes", "at", "upto", "before"])

    return batchwise


def _carried(base: int, carry: Callable[[], dict]):
    """Places and products of whole conversations from those of the partitions' stretches."""

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = carry()
        for batch in batches:
            places, products, before = (batch[name].to_pylist() for name in ("at", "upto", "before"))
            for row, key in enumerate(zip(batch["conv_id"].to_pylist(), batch["part"].to_pylist(), strict=True)):
                if key in ahead:
                    n, product = ahead[key]
                    power = pow(base, places[row] - 1, PRIME)
                    before[row] = _stored((product * power + _number(before[row])) % PRIME)
                    products[row] = _stored((product * power * base + _number(products[row])) % PRIME)
                    places[row] += n
            yield pa.RecordBatch.from_arrays(
                [*(batch[name] for name in ("conv_id", "code", "n_bytes")), pa.array(places, pa.int64()),
                 pa.array(products, pa.binary()), pa.array(before, pa.binary())],
                ["conv_id", "code", "n_bytes", "at", "upto", "before"])

    return batchwise


def own_prefixes(turns: DataFrame, seed: int) -> DataFrame:
    """(conv_id, code, n_bytes, at, upto, before) of every turn: its place from 1 on, and the products with and without it."""
    base, order = base_of(seed), ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    spread = turns.withColumn("spread", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    ranged = spread.repartitionByRange(*order, "spread").sortWithinPartitions(*order).select(
        "conv_id", F.spark_partition_id().alias("part"), "code", F.octet_length("text").cast("long").alias("n_bytes"))
    local = checkpointed(ranged.mapInArrow(
        _products(base), "conv_id long, part int, code binary, n_bytes long, at long, upto binary, before binary"))
    stretches = local.groupBy("conv_id", "part").agg(F.max("at").alias("n"), F.max_by("upto", "at").alias("upto"))
    crossing = stretches.groupBy("conv_id").agg(
        F.count("*").alias("parts"), F.min("part").alias("low"), F.max("part").alias("high")).where("parts > 1")
    # A conversation lies in neighbouring partitions, so at most two of them cross a partition's borders.
    carry: dict = {}
    rows = stretches.join(crossing.select("conv_id"), "conv_id").collect()
    state: dict = {}
    for row in sorted(rows, key=lambda r: (r.conv_id, r.part)):
        n, product = state.get(row.conv_id, (0, 0))
        carry[row.conv_id, row.part] = n, product
        state[row.conv_id] = n + row.n, (product * pow(base, row.n, PRIME) + _number(row.upto)) % PRIME
    sent = turns.sparkSession.sparkContext.broadcast(carry)
    return local.mapInArrow(
        _carried(base, lambda: sent.value), "conv_id long, code binary, n_bytes long, at long, upto binary, before binary")


def _composed(base: int):
    """Fingerprints of rebuilt prefixes: head times BASE**j plus the own turns between two places."""

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, parents = [], []
            for n, upto, before, skipped, head in zip(*(batch[name].to_pylist() for name in (
                    "n_own", "upto", "before", "skipped", "head_product")), strict=True):
                lead = (_number(head) - _number(skipped)) * pow(base, n - 1, PRIME)
                parents.append(_stored((lead + _number(before)) % PRIME))
                prints.append(_stored((lead * base + _number(upto)) % PRIME))
            yield pa.RecordBatch.from_arrays(
                [*(batch[name] for name in ("conv_id", "depth", "last", "code", "n_bytes", "from_conv", "from_at")),
                 pa.array(prints, pa.binary()), pa.array(parents, pa.binary())],
                ["conv_id", "depth", "last", "code", "n_bytes", "from_conv", "from_at", "print", "parent"])

    return batchwise


REBUILT = (
    "conv_id long, depth long, last boolean, code binary, n_bytes long, from_conv long, from_at long, "
    "print binary, parent binary")


def rebuilt_prefixes(own: DataFrame, base_id: Callable[[Column], Column], head: Callable[[Column], Column], seed: int) -> DataFrame:
    """One row per conversation and depth, the root included (see ``REBUILT``); texts stay where they are."""
    conv = F.col("conv_id")
    lengths = own.groupBy("conv_id").agg(F.max("at").alias("n_turns"))
    convs = lengths.select("conv_id", "n_turns", head(conv).cast("long").alias("head"), base_id(conv).cast("long").alias("base_id"))
    convs = convs.join(lengths.select(F.col("conv_id").alias("base_id"), F.col("n_turns").alias("n_base")), "base_id", "left")
    kept = F.least("head", F.coalesce("n_base", F.lit(0)))
    convs = checkpointed(convs.withColumns({
        "kept": kept, "total": kept + F.greatest(F.col("n_turns") - F.col("head"), F.lit(0))}))

    heads = convs.where("kept > 0").select("conv_id", "base_id", "kept", "total").join(
        own.withColumnRenamed("conv_id", "base_id"), "base_id").where("at <= kept")
    head_rows = heads.select(
        "conv_id", F.col("at").alias("depth"), (F.col("at") == F.col("total")).alias("last"), "code", "n_bytes",
        F.col("base_id").alias("from_conv"), F.col("at").alias("from_at"), F.col("upto").alias("print"), F.col("before").alias("parent"))
    whole_heads = heads.where("at = kept").select("conv_id", F.col("upto").alias("head_product"))
    skipped = own.where(F.col("at") == head(conv)).select("conv_id", F.col("upto").alias("skipped"))
    params = convs.where("n_turns > head").select("conv_id", "head", "kept", "total").join(
        whole_heads, "conv_id", "left").join(skipped, "conv_id", "left")
    n_own = F.col("at") - F.col("head")
    suffixes = own.where(F.col("at") > head(conv)).join(params, "conv_id").select(
        "conv_id", (F.col("kept") + n_own).alias("depth"), (F.col("kept") + n_own == F.col("total")).alias("last"), "code",
        "n_bytes", F.col("conv_id").alias("from_conv"), F.col("at").alias("from_at"), n_own.alias("n_own"), "upto", "before",
        F.coalesce("skipped", F.lit(ROOT)).alias("skipped"), F.coalesce("head_product", F.lit(ROOT)).alias("head_product"))
    zero = F.lit(0).cast("long")
    roots = convs.select(
        "conv_id", zero.alias("depth"), (F.col("total") == 0).alias("last"), F.lit(b"").alias("code"), zero.alias("n_bytes"),
        F.lit(None).cast("long").alias("from_conv"), zero.alias("from_at"), F.lit(ROOT).alias("print"), F.lit(b"").alias("parent"))
    return roots.unionByName(head_rows).unionByName(suffixes.mapInArrow(_composed(base_of(seed)), REBUILT))


def verified(turns: DataFrame, nodes: DataFrame) -> bool:
    """Whether every code stands for one role and text, and every node's members agree in last turn and prefix."""
    differ = lambda name: F.min(name) != F.max(name)
    codes = turns.groupBy("code").agg((differ("role") | differ("text")).alias("bad"))
    return codes.where("bad").isEmpty() and nodes.where("mixed").isEmpty()


def suffix_sums(rows: DataFrame, names: list[str]) -> DataFrame:
    """Every sum over a conversation's rows at this depth and below, for (conv_id, depth) once each."""
    blocked = rows.withColumn("block", F.floor(F.col("depth") / BLOCK))
    below = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("conv_id", "block").agg(*(F.sum(name).alias(name) for name in names))
    totals = totals.select("conv_id", "block", *(
        F.coalesce(F.sum(name).over(below), F.lit(0)).alias(f"{name}_below") for name in names))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    return blocked.withColumns({name: F.sum(name).over(inside) for name in names}).join(totals, ["conv_id", "block"]).select(
        "depth", "print", *((F.col(name) + F.col(f"{name}_below")).alias(name) for name in names))


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None

    def made(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.string())],
            ["depth", "print", "ends_sha256"])

    for batch in batches:
        rows = []
        for depth, node, ids in zip(*(batch[name].to_pylist() for name in ("depth", "print", "ids")), strict=True):
            if key == (depth, node):
                digest.update(b"," + ids.encode())
                continue
            if key is not None:
                rows.append((*key, digest.hexdigest()))
            key, digest = (depth, node), hashlib.sha256(ids.encode())
        yield made(rows)
    if key is not None:
        yield made([(*key, digest.hexdigest())])


def end_hashes(rebuilt: DataFrame) -> DataFrame:
    """(depth, print, ends_sha256) of the nodes at which some rebuilt conversation ends."""
    ends = rebuilt.where("last").groupBy("depth", "print", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list("conv_id")).alias("ids"))
    joined = ends.select("depth", "print", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    sorted_ = joined.repartition("depth", "print").sortWithinPartitions("depth", "print", "block")
    return sorted_.mapInArrow(_end_hashes, "depth long, print binary, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame, base_id: Callable[[Column], Column], head: Callable[[Column], Column], seed: int = 0,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    from_conv and from_at, the stored turn that is the node's last one.

    ``base_id`` and ``head`` give the base conversation and the number of its turns from a conversation's id.
    """
    while True:
        turns = coded_turns(conversations, seed)
        own = checkpointed(own_prefixes(turns, seed))
        rebuilt = checkpointed(rebuilt_prefixes(own, base_id, head, seed))
        member = F.struct("conv_id", "from_conv", "from_at")
        nodes = checkpointed(rebuilt.groupBy("depth", "print").agg(
            F.min(member).alias("least"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"),
            F.min("parent").alias("parent"),
            ((F.min("parent") != F.max("parent")) | (F.min("code") != F.max("code"))).alias("mixed")))
        if verified(turns, nodes):
            break
        seed += 1

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("print")).agg(
        F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "print"], "left").select(
        "depth", "print", "parent", F.col("least.conv_id").alias("conv_id"), F.col("least.from_conv").alias("from_conv"),
        F.col("least.from_at").alias("from_at"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    nodes = checkpointed(nodes)
    owned = nodes.select("conv_id", "depth", F.col("saved").alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    owners = owned.select("conv_id").distinct()
    paths = rebuilt.select("conv_id", "depth", "print").join(owners, "conv_id").join(owned, ["conv_id", "depth"], "left")
    sums = suffix_sums(paths.fillna(0, ["saved_tokens", "n_leaves"]), ["saved_tokens", "n_leaves"])
    sums = sums.groupBy("depth", "print").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("print").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(sums, ["depth", "print"]).join(end_hashes(rebuilt), ["depth", "print"], "left").join(
        parents, ["depth", "parent"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "from_conv", "from_at")
