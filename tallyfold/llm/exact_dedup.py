"""Exact deduplication over a cuckoo-filter index of live digests.

The index is a table with one row per bucket of digests: the slots of a cuckoo filter, the digests stored there
and, for each, how many live rows have it and which row is kept. A batch of insertions or deletions is combined
by digest (map-side first, so a digest that a third of all rows share is one row a task, then one row), shuffled by
bucket and applied to that bucket's filter. A miss proves a digest new. A hit is verified against the stored
digests of the bucket, since two digests may share a fingerprint. When an insertion finds no slot the filter
doubles and is filled again from the stored digests. A digest whose kept row was deleted gets the next one from the
live rows. Buckets are numbered by the row count, so each holds a bounded number of digests whatever the input size.

Texts are equal when identical without the characters ``[ \\t-\\r]``. Null text counts as empty; all empty texts are
equal. The row with most code points stays, then the smallest ``doc_id`` (null last). Rows repeated with one
``doc_id`` count towards the group and exactly one of them is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import random
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import checkpointed, unused, whole_text

WHITE = " \t\n\x0b\f\r"
SLOTS = 4
KICKS = 500


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four slots; a key may lie in either of two buckets."""

    def __init__(self, buckets: int = 64, slots: bytes | None = None):
        self.slots = array("H", slots if slots else bytes(2 * SLOTS * buckets))
        self.mask = len(self.slots) // SLOTS - 1
        self.random = random.Random(self.mask)

    @staticmethod
    def _fingerprint(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") or 1

    def _other(self, bucket: int, fingerprint: int) -> int:
        return (bucket ^ (fingerprint * 0x5BD1E995)) & self.mask

    def _places(self, key: bytes) -> tuple[int, int, int]:
        fingerprint = self._fingerprint(key)
        first = int.from_bytes(key[:8], "little") & self.mask
        return fingerprint, first, self._other(first, fingerprint)

    def _slot(self, bucket: int, fingerprint: int) -> int:
        for at in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if self.slots[at] == fingerprint:
                return at
        return -1

    def __contains__(self, key: bytes) -> bool:
        fingerprint, first, second = self._places(key)
        return self._slot(first, fingerprint) >= 0 or self._slot(second, fingerprint) >= 0

    def insert(self, key: bytes) -> bool:
        """False when no slot was found; the filter must then be built again at twice the size."""
        fingerprint, first, second = self._places(key)
        for bucket in (first, second):
            if (at := self._slot(bucket, 0)) >= 0:
                self.slots[at] = fingerprint
                return True
        bucket = second
        for _ in range(KICKS):
            at = SLOTS * bucket + self.random.randrange(SLOTS)
            fingerprint, self.slots[at] = self.slots[at], fingerprint
            bucket = self._other(bucket, fingerprint)
            if (at := self._slot(bucket, 0)) >= 0:
                self.slots[at] = fingerprint
                return True
        return False

    def delete(self, key: bytes) -> None:
        """Only for keys known to be stored."""
        fingerprint, first, second = self._places(key)
        at = self._slot(first, fingerprint)
        self.slots[at if at >= 0 else self._slot(second, fingerprint)] = 0


def filled(keys, buckets: int) -> CuckooFilter:
    """A filter that holds all keys, doubled as often as needed."""
    while True:
        made = CuckooFilter(buckets)
        if all(map(made.insert, keys)):
            return made
        buckets *= 2


class Bucket:
    """One bucket of the index: filter, stored digests, and (live rows, code points, kept doc_id) of each."""

    def __init__(self, slots: bytes | None = None, stored: dict | None = None):
        self.stored = stored or {}
        self.filter = CuckooFilter(slots=slots) if slots else CuckooFilter()

    def _live(self, key: bytes) -> list | None:
        return self.stored.get(key) if key in self.filter else None

    def insert(self, key: bytes, rows: int, n_chars: int, doc_id: int | None) -> None:
        if (entry := self._live(key)) is None:
            self.stored[key] = [rows, n_chars, doc_id]
            if not self.filter.insert(key):
                self.filter = filled(self.stored, 2 * (self.filter.mask + 1))
            return
        entry[0] += rows
        if entry[1] is not None and _rank(n_chars, doc_id) < _rank(entry[1], entry[2]):
            entry[1:] = n_chars, doc_id

    def delete(self, key: bytes, rows: int, n_chars: int, doc_id: int | None) -> None:
        """Takes rows off a live digest. Without rows it goes; without its kept row it waits for ``name``."""
        if (entry := self._live(key)) is None:
            return
        entry[0] -= rows
        if entry[0] <= 0:
            del self.stored[key]
            self.filter.delete(key)
        elif entry[1:] == [n_chars, doc_id]:
            entry[1:] = None, None

    def name(self, key: bytes, n_chars: int, doc_id: int | None) -> None:
        """Which of the live rows of a digest is kept now."""
        if (entry := self._live(key)) is not None:
            entry[1:] = n_chars, doc_id


def _rank(n_chars: int, doc_id: int | None) -> tuple:
    return -n_chars, doc_id is None, doc_id or 0


CHANGES = "bucket int, digest binary, n_rows long, n_chars long, doc_id long"
INDEX = (
    "bucket int, slots binary, digests array<binary>, n_rows array<long>, n_chars array<long>, doc_ids array<long>"
)
_INDEX_ARROW = pa.schema([
    ("bucket", pa.int32()), ("slots", pa.binary()), ("digests", pa.list_(pa.binary())),
    ("n_rows", pa.list_(pa.int64())), ("n_chars", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())),
])


def digest_of(text: Column) -> Column:
    """SHA-256 (hex) of the text without white space."""
    for character in WHITE:
        text = F.replace(text, F.lit(character), F.lit(""))
    return F.sha2(text, 256)


def with_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_points, digest) of every row."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.char_length(whole_text()).cast("long").alias("n_points"),
        digest_of(whole_text()).alias("digest"))


def _applied(key: tuple, stored: pa.Table, changes: pa.Table) -> pa.Table:
    bucket = Bucket()
    for row in stored.to_pylist():
        entries = zip(row["n_rows"], row["n_chars"], row["doc_ids"], strict=True)
        bucket = Bucket(row["slots"], dict(zip(row["digests"], map(list, entries), strict=True)))
    for row in changes.select(["digest", "n_rows", "n_chars", "doc_id"]).to_pylist():
        digest, n_rows, n_chars, doc_id = row.values()
        if n_rows > 0:
            bucket.insert(digest, n_rows, n_chars, doc_id)
        elif n_rows == 0:
            bucket.name(digest, n_chars, doc_id)
        else:
            bucket.delete(digest, -n_rows, n_chars, doc_id)
    entries = list(bucket.stored.values())
    return pa.Table.from_pylist([{
        "bucket": key[0].as_py(), "slots": bucket.filter.slots.tobytes(), "digests": list(bucket.stored),
        "n_rows": [e[0] for e in entries], "n_chars": [e[1] for e in entries], "doc_ids": [e[2] for e in entries],
    }], schema=_INDEX_ARROW)


def _combined(digests: DataFrame, buckets: int, rows: Column) -> DataFrame:
    """One change per digest: how many rows, and which of them ranks first."""
    key = F.unhex("digest")
    first = F.min(F.struct((-F.col("n_points")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")))
    combined = digests.groupBy("digest").agg(rows.cast("long").alias("n_rows"), first.alias("first"))
    return combined.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), key.alias("digest"), "n_rows",
        (-F.col("first.fewer")).alias("n_chars"), F.col("first.id").alias("doc_id"))


def _with_changes(index: DataFrame, changes: DataFrame) -> DataFrame:
    return index.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInArrow(_applied, INDEX)


def update(index: DataFrame | None, digests: DataFrame, buckets: int, insert: bool = True) -> DataFrame:
    """The index after inserting or deleting the rows of ``digests`` (as ``with_digests`` gives them).

    ``buckets`` must be the number the index was made with. Deleting digests that are not live changes nothing.
    Deletions of several rows with one digest are combined, so a kept row among them is forgotten only if it
    ranks first of the deleted ones, which it always does. A digest without its kept row has none until ``named``.
    """
    if index is None:
        index = digests.sparkSession.createDataFrame([], INDEX)
    rows = F.count("*")
    return _with_changes(index, _combined(digests, buckets, rows if insert else -rows))


def named(index: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """The index with a kept row for each live digest that lost its own, after deletions or later insertions.

    ``rows`` are all live rows (as ``with_digests`` gives them). Only those of digests without a kept row are
    compared, one candidate per task and digest, so the index itself need not store every row of a group.
    """
    forgotten = live(index).where("keep_points IS NULL").select("digest")
    return _with_changes(index, _combined(rows.join(forgotten, "digest", "left_semi"), buckets, F.lit(0)))


def live(index: DataFrame) -> DataFrame:
    """(digest, group_size, keep_id, keep_points) of the live digests of an index."""
    entry = F.explode(F.arrays_zip("digests", "n_rows", "n_chars", "doc_ids")).alias("e")
    return index.select(entry).select(
        F.lower(F.hex("e.digests")).alias("digest"), F.col("e.n_rows").alias("group_size"),
        F.col("e.doc_ids").alias("keep_id"), F.col("e.n_chars").alias("keep_points"))


def bucket_count(rows: int, bucket_rows: int = 20_000) -> int:
    return rows // bucket_rows + 1


def groups(digests: DataFrame) -> DataFrame:
    """Live digests of a whole table: an empty index, one batch of insertions."""
    return live(update(None, digests, bucket_count(digests.count())))


def decisions(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; columns besides doc_id and text are ignored."""
    digests = checkpointed(with_digests(docs))
    repeats = Window.partitionBy("doc_id", "digest").orderBy(F.desc("n_points"))
    numbered = digests.withColumn("copy", F.row_number().over(repeats))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return numbered.join(groups(digests), "digest").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns. Texts move once, keyed so that no group of copies is hot."""
    keys = [unused(name, docs) for name in ("_digest", "_id", "_points")]
    own = (digest_of(whole_text()), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.char_length(whole_text()).cast("long"))
    keyed = docs.withColumns(dict(zip(keys, own, strict=True)))
    winners = groups(with_digests(docs)).select(
        "digest", F.coalesce(F.col("keep_id").cast("string"), F.lit("")), "keep_points").toDF(*keys)
    return keyed.join(winners, keys, "left_semi").dropDuplicates(keys).select(docs.columns)
