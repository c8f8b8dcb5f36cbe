"""Exact n-gram Jaccard similarity: retrieval of examples, and leakage of examples into a text set.

Examples are a stated set that every text is scored against; nearly every pair of texts shares some bigram, so no index
on grams would save comparisons. Both sides stay in Spark: the examples are cut into blocks and the texts into chunks of
bounded size, each block meets each chunk in one task, which scores all their pairs in arrays (an inverted index of the
block's grams, one count per pair) and passes on only the best of each text. The best of all blocks are merged per
text. Nothing is collected, no row per pair exists, and there is one way for any number of texts or examples.

``similar_pairs`` joins two large sets by prefix filtering: two sets can only reach a similarity of t if their
rarest grams overlap, so only texts that share such a gram, and whose sizes and gram positions still allow t, are
ever compared. It suits high thresholds and longer grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.text import jaccard, ngrams

# Gram length, examples per question, lowest useful score, leakage threshold.
GRAM_LENGTH = 2
EXAMPLES_PER_QUESTION = 2
LOWEST_SCORE = 0.15
LEAKAGE_THRESHOLD = 0.35

# Characters of the examples and of the texts that meet in one task, the least number of chunks of texts, and how many
# pairs of them are scored at once.
BLOCK_CHARACTERS = 1_000_000
CHUNK_CHARACTERS = 4_000_000
LEAST_CHUNKS = 16
CELLS = 1 << 19


def gram_sets(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``<key>, grams, size`` of texts long enough to have a gram."""
    sets = df.select(key, ngrams(F.col(text), n).alias("grams")).withColumn("size", F.size("grams"))
    return sets.where(F.col("size") > 0)


def similar_pairs(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float, n: int = GRAM_LENGTH,
    text: str = "text",
) -> DataFrame:
    """All pairs with a similarity of at least ``threshold`` > 0: ``<left_key>, <right_key>, score``.

    A gram of the left side that is in very many texts meets a skewed join key; Spark splits such a
    partition at run time, since nothing after the join relies on its partitioning.
    """
    lefts, rights = gram_sets(left, left_key, text, n), gram_sets(right, right_key, text, n)
    used = lefts.select(F.explode("grams").alias("gram")).unionByName(rights.select(F.explode("grams").alias("gram")))
    frequency = used.groupBy("gram").agg(F.count("*").alias("frequency"))

    def prefixes(sets: DataFrame, key: str, side: str) -> DataFrame:
        """The rarest grams of each set that must hold a shared one, with their places."""
        ranked = (
            sets.select(key, "size", F.explode("grams").alias("gram")).join(frequency, "gram")
            .groupBy(key, "size").agg(F.array_sort(F.collect_list(F.struct("frequency", "gram"))).alias("ranked"))
        )
        kept = F.col("size") - F.ceil(F.col("size") * F.lit(threshold)).cast("int") + 1
        rarest = F.slice(F.col("ranked.gram"), F.lit(1), kept)
        return ranked.select(key, F.col("size").alias(f"{side}_size"), F.posexplode(rarest).alias(f"{side}_at", "gram"))

    ours, theirs = prefixes(lefts, left_key, "left"), prefixes(rights, right_key, "right")
    left_size, right_size = F.col("left_size"), F.col("right_size")
    needed = F.ceil((left_size + right_size) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    possible = F.least(left_size - F.col("left_at"), right_size - F.col("right_at"))
    candidates = (
        ours.join(theirs, "gram")
        .where((F.least(left_size, right_size) >= F.greatest(left_size, right_size) * threshold - 1e-9) & (possible >= needed))
        .select(left_key, right_key).distinct()
    )
    scored = (
        candidates.join(lefts.select(left_key, F.col("grams").alias("left_grams")), left_key)
        .join(rights.select(right_key, F.col("grams").alias("right_grams")), right_key)
        .select(left_key, right_key, jaccard(F.col("left_grams"), F.col("right_grams")).alias("score"))
    )
    return scored.where(F.col("score") >= threshold)


def gram_codes(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, code) of the distinct n-grams of each text, sorted by both. Codes of equal grams are equal."""
    whole = [text or "" for text in texts]
    points = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter(map(len, whole), np.int64, len(whole))
    owner, ends = np.repeat(np.arange(len(whole)), lengths), np.cumsum(lengths)
    at = np.flatnonzero(np.arange(n, len(points) + n) <= ends[owner])
    if n <= 3:
        codes = sum(points[at + i].astype(np.uint64) << np.uint64(21 * i) for i in range(n))
    else:
        codes = np.ascontiguousarray(points[at[:, None] + np.arange(n)]).view(f"<U{n}").ravel()
    owner = owner[at]
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1]))) if len(owner) else np.empty(0, bool)
    return owner[first], codes[first]


class Index:
    """The grams of a block of strings, and which strings have each."""

    def __init__(self, strings: list[str], n: int):
        owner, codes = gram_codes(strings, n)
        self.n, self.sizes = n, np.bincount(owner, minlength=len(strings))
        order = np.argsort(codes, kind="stable")
        self.holders = owner[order]
        self.codes, self.starts, self.counts = np.unique(codes[order], return_index=True, return_counts=True)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Similarity of each text (row) to each string (column)."""
        owner, codes = gram_codes(texts, self.n)
        sizes = np.bincount(owner, minlength=len(texts))
        at = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        hit = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        owner, at = owner[hit], at[hit]
        counts = self.counts[at]
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        pair = np.repeat(owner, counts) * len(self.sizes) + self.holders[np.repeat(self.starts[at], counts) + within]
        shared = np.bincount(pair, minlength=len(texts) * len(self.sizes)).reshape(len(texts), len(self.sizes))
        union = sizes[:, None] + self.sizes - shared
        return np.divide(shared, union, out=np.zeros(shared.shape), where=union > 0)

    def in_parts(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """The scores of a bounded number of pairs at a time, and the first text's place."""
        step = max(1, CELLS // max(1, len(self.sizes)))
        for at in range(0, len(texts), step):
            yield at, self.scores(texts[at:at + step])


def example_strings(examples: DataFrame) -> DataFrame:
    """Everything a question is compared with: each example's question and each of its keywords."""
    listed = F.concat(F.array("question"), F.filter(F.split(F.coalesce("keywords", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    return examples.select(F.col("ordinal").cast("long").alias("ordinal"), F.explode(listed).alias("text"))


def best_of_blocks(
    texts: DataFrame, strings: DataFrame, text: str, k: int, lowest: float, n: int, block_characters: int,
) -> DataFrame:
    """(digest, best): up to k ``struct<rank, ordinal>`` of each text with a score of ``lowest``, best first; rank is the
    negative score. ``strings`` has ``ordinal, text``; an ordinal's score is that of its best string. Texts are known by
    ``text_digest``; null counts as empty."""
    sizes = texts.select(F.lit(1).alias("side"), F.char_length(F.coalesce(F.col(text), F.lit(""))).alias("c")).unionByName(
        strings.select(F.lit(0).alias("side"), F.char_length(F.coalesce("text", F.lit(""))).alias("c"))).groupBy("side").agg(
        F.sum(F.col("c") + 64).alias("c")).collect()
    size = {row["side"]: row["c"] for row in sizes}
    blocks = -(-size.get(0, 0) // block_characters) or 1
    chunks = max(-(-size.get(1, 0) // CHUNK_CHARACTERS), LEAST_CHUNKS)

    places = lambda number, name: F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias(name)
    left = distinct_texts(texts, text).select(
        "digest", "text", F.pmod(F.xxhash64("digest"), F.lit(chunks)).cast("int").alias("chunk"), places(blocks, "block"))
    right = strings.select(
        "ordinal", F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("ordinal"), F.lit(blocks)).cast("int").alias("block"),
        places(chunks, "chunk"))

    def scored(chunk: pa.Table, block: pa.Table) -> pa.Table:
        ordinals = block["ordinal"].to_numpy()
        order = np.argsort(ordinals, kind="stable")
        ordinals, digests, found = ordinals[order], chunk["digest"].to_pylist(), ([], [], [])
        listed = block["text"].take(pa.array(order)).to_pylist()
        starts = np.flatnonzero(np.concatenate(([True], ordinals[1:] != ordinals[:-1]))) if len(ordinals) else []
        if len(starts):
            for first, scores in Index(listed, n).in_parts(chunk["text"].to_pylist()):
                best = np.maximum.reduceat(scores, starts, axis=1)
                top = np.argsort(-best, axis=1, kind="stable")[:, :k]
                ranked = np.take_along_axis(best, top, axis=1)
                row, place = np.nonzero(ranked >= lowest)
                found[0].extend(digests[first + at] for at in row.tolist())
                found[1].extend((-ranked[row, place]).tolist())
                found[2].extend(ordinals[starts][top[row, place]].tolist())
        return pa.table({
            "digest": pa.array(found[0], pa.binary()), "rank": pa.array(found[1], pa.float64()), "ordinal": pa.array(found[2], pa.int64())})

    hits = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(
        scored, "digest binary, rank double, ordinal long")
    ranked = F.array_sort(F.collect_set(F.struct("rank", "ordinal")))
    return hits.groupBy("digest").agg(F.slice(ranked, 1, k).alias("best"))


def text_digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def distinct_texts(df: DataFrame, text: str) -> DataFrame:
    """(digest, text) of every text once, null as empty. The shuffle also deals the texts of one large file to all tasks."""
    return df.select(text_digest(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()


def best_examples(
    questions: DataFrame, examples: DataFrame, key: str, text: str = "text", k: int = EXAMPLES_PER_QUESTION,
    lowest: float = LOWEST_SCORE, n: int = GRAM_LENGTH, block_characters: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """Up to k examples per question with a score of at least ``lowest``: ``<key>, place, ordinal, score``.

    ``examples`` has ``ordinal, question, keywords``; the score is the best similarity to its question
    or any keyword, and equal scores keep the order of the examples. With ``lowest`` 0 every question gets k
    examples, also ones that share no gram. Questions with one key are answered each.
    """
    best = best_of_blocks(questions, example_strings(examples), text, k, lowest, n, block_characters)
    answered = questions.select(key, text_digest(text).alias("_digest")).join(best, F.col("_digest") == F.col("digest"))
    answered = answered.select(key, F.posexplode("best").alias("at", "hit"))
    return answered.select(key, (F.col("at") + 1).alias("place"), "hit.ordinal", (-F.col("hit.rank")).alias("score"))


def leakage_groups(
    items: DataFrame, examples: DataFrame, key: str, text: str = "text", threshold: float = LEAKAGE_THRESHOLD,
    n: int = GRAM_LENGTH, block_characters: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """Every item with its group and, if leaked, its similarity to the closest example.

    Items are ``leaked`` from ``threshold`` on and ``clean`` below it.
    """
    strings = examples.select(F.col(text).alias("text")).distinct().select(F.xxhash64("text").alias("ordinal"), "text")
    best = best_of_blocks(items, strings, text, 1, threshold, n, block_characters)
    nearest = items.select(key, text_digest(text).alias("_digest")).join(best, F.col("_digest") == F.col("digest"), "left")
    similarity = -F.get("best", F.lit(0))["rank"]
    return nearest.select(
        key, F.when(similarity.isNotNull(), "leaked").otherwise("clean").alias("leakage"), similarity.alias("similarity"))


def leakage_accuracy(groups: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Questions and accuracy per run and leakage group. The log has ``run, <key>, correct``."""
    joined = log.join(groups.select(key, "leakage"), key)
    counted = joined.groupBy("run", "leakage").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    return counted.select("run", "leakage", "total", F.round(F.col("correct") * 100 / F.col("total"), 1).alias("accuracy"))
