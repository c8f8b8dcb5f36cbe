"""Importance resampling towards a target distribution, over hashed runs of words.

Features are all runs of 1 to ``runs`` consecutive words, joined by one space; a feature's bucket is the CRC-32 of its
UTF-8 bytes modulo ``buckets``. The CRCs of a block of texts are computed together: the distinct features are grouped by
byte length, each group is a two-dimensional array of bytes, and one table step per column updates the CRCs of all its
rows; the buckets are then scattered back to the places of the features. A block holds about ``BLOCK_BYTES`` of text.

First pass: bucket counts of the source and of the target, summed per task and then grouped, so that what moves is one
row per task and bucket. They give one gain per bucket (a table of fixed size). Second pass: the mean gain of each
document. Which documents are drawn follows from the histogram of scores: only rows at or above the lowest score that
can be drawn are ranked. Scores are ranked apart from each other; inside a score equal ids are counted in ``SPREAD``
parts, so neither one frequent score nor one repeated id makes a group that has to be ordered as a whole.

A word is a run of ``[0-9a-z]`` and characters beyond ASCII, A-Z in lower case. Null and empty texts have no features:
weight 0, not drawn while ``least_words`` is above 0. A null doc_id is hashed as the empty text and comes after all
others in ties; repeated rows are each scored and, where drawn, get ranks of their own. Texts are read whole. With an
empty target all gains come from the smoothing; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import checkpointed

BLOCK_BYTES = 1 << 20
SPREAD = 64
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_WORD_BYTES = bytes(c if c in _KEPT or c > 0x7F else 0x20 for c in bytes(range(256)).lower())
_CRC_STEPS = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_WORD_BYTES).split()


def features_of(words: list[bytes], runs: int) -> list[bytes]:
    found = list(words)
    for size in range(2, runs + 1):
        found += map(b" ".join, zip(*(words[at:] for at in range(size)), strict=False))
    return found


def crc32s(keys: list[bytes]) -> np.ndarray:
    """CRC-32 of every key: one matrix of bytes per length, all its rows updated column by column."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(lengths, kind="stable")
    out = np.empty(len(keys), np.uint32)
    if not keys:
        return out
    sizes, firsts = np.unique(lengths[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, firsts[1:]), strict=True):
        matrix = np.frombuffer(b"".join([keys[at] for at in rows]), np.uint8).reshape(len(rows), size)
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            crc = _CRC_STEPS[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
        out[rows] = ~crc
    return out


def _blocks(texts: Iterator[bytes | None], runs: int, buckets: int) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """Word counts and feature counts of the texts of a block, and the buckets of all their features in order."""
    places: dict[bytes, int] = {}
    n_words, n_features, at, size = [], [], [], 0

    def made():
        hashed = (crc32s(list(places)) % np.uint32(buckets)).astype(np.int64)
        return n_words, n_features, hashed[np.array(at, np.int64)]

    for text in texts:
        words = words_of(text or b"")
        found = features_of(words, runs)
        n_words.append(len(words))
        n_features.append(len(found))
        at += [places.setdefault(feature, len(places)) for feature in found]
        size += len(text or b"")
        if size > BLOCK_BYTES:
            yield made()
            places, n_words, n_features, at, size = {}, [], [], [], 0
    if n_words:
        yield made()


def _utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def bucket_counts(docs: DataFrame, runs: int, buckets: int) -> DataFrame:
    """(bucket, n): how often features of each bucket occur in the texts; empty buckets have no row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in _blocks(_utf8(batch.column(0)), runs, buckets):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    return docs.select(F.col("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, runs: int, buckets: int) -> list[int]:
    """One gain per bucket, in thousandths, from smoothed shares of target and source."""
    counts = bucket_counts(source, runs, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(
        bucket_counts(target, runs, buckets).select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    s, t = [0] * buckets, [0] * buckets
    for row in counts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[row.bucket], t[row.bucket] = row.s, row.t
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t, strict=True)]


def _weighed(gain: Callable[[], list[int]], runs: int, buckets: int):
    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = np.array(gain(), np.int64)
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for words, features, found in _blocks(_utf8(batch.column(1)), runs, buckets):
                sums = np.concatenate(([0], np.cumsum(gain_of[found])))
                ends = np.cumsum(features)
                total = sums[ends] - sums[ends - features]
                n_words += words
                n_features += features
                weights += (total // np.maximum(features, 1)).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weights))],
                ["doc_id", "n_words", "n_features", "weight"])

    return batchwise


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, runs: int = 1, buckets: int = 10_000,
    seed: int = 2024,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null where a row is not drawn.

    Drawn are ``percent`` per cent, rounded down, of the rows with ``least_words`` words: those of the highest scores,
    ties to the smaller doc_id. A score is the weight plus Gumbel noise, so rows are drawn by weight without replacement.
    """
    sent = docs.sparkSession.sparkContext.broadcast(gains(docs, target, runs, buckets))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _weighed(lambda: sent.value, runs, buckets), "doc_id long, n_words long, n_features long, weight long")
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).alias("part")
    rows = checkpointed(rows.select("*", part))

    # One row per distinct score: weights and noise are thousandths of logarithms, some ten thousand values in all.
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    enough = F.col("n_words") >= least_words
    steps = rows.where(enough).groupBy("score").agg(F.count("*").alias("n"))
    steps = checkpointed(steps.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))))
    wanted = percent * (steps.agg(F.sum("n")).first()[0] or 0) // 100
    least = steps.where(F.col("before") < wanted).agg(F.min("score")).first()[0]
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))

    near = enough & (F.col("score") >= least)
    parts = rows.where(near).groupBy("score", "doc_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "part").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        steps.select("score", "before"), "score").select(
        F.col("score").alias("of_score"), F.col("doc_id").alias("of_doc"), F.col("part").alias("of_part"),
        (F.col("before") + F.col("ahead")).alias("offset"))
    copies = Window.partitionBy("score", "doc_id", "part").orderBy("n_features", "weight", "n_words")
    drawn = rows.where(near).withColumn("copy", F.row_number().over(copies)).join(
        parts, (F.col("score") == F.col("of_score")) & F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("part") == F.col("of_part")))
    rank = F.col("offset") + F.col("copy")
    drawn = drawn.select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionByName(rows.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")))
