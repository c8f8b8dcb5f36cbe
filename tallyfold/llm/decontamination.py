"""Training documents that contain benchmark items, copied or edited.

Words are runs of letters and digits in lower case. Of each item the rarest ``GRAM``-word run of every slice of
``SLICE`` words is a seed; rarity is the product of the words' corpus frequencies, counted over all documents, so a
passage that leaked often does not make its own seeds common. Documents meet items where seeds match. Where at
least two different seeds of an item (one, if it has no more) lie on nearby diagonals, the stretch of the document is
aligned with the item by Smith-Waterman on words (match 2, mismatch and gap -1). The score is the alignment's share
of a perfect one. A document is contaminated by an item from ``SCORE`` on, if at least ``WORDS`` words (or the whole
item) match.

Items are handled in blocks of about ``BLOCK_BYTES`` of text, each a pass over the documents, so what travels to the
tasks is bounded whatever the number of items. Null and empty texts and items without words match nothing. Items
repeated with one ``item_id`` are each aligned and reported once, with the best score. Documents of any length are
read whole. Rows repeated with one ``doc_id`` give one row per item. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import whole_text

GRAM = 3
SLICE = 2
SCORE = 0.5
WORDS = 8
BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, 1
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the ends of that alignment in item and stretch (exclusive)."""
    step = GAP * np.arange(len(item) + 1)
    row, best, at = np.zeros(len(item) + 1, np.int64), 0, (0, 0)
    for j, word in enumerate(stretch):
        diagonal = row[:-1] + np.where(item == word, MATCH, MISMATCH)
        new = np.maximum(row - GAP, 0)
        np.maximum(new[1:], diagonal, out=new[1:])
        row = np.maximum.accumulate(new + step) - step
        if (top := int(row.max())) > best:
            best, at = top, (int(row.argmax()), j + 1)
    return best, *at


@dataclass
class Block:
    """Items of one block, their vocabulary (0: any other word) and their seeds."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    codes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # sorted
    owners: list[list[tuple[int, int]]] = field(default_factory=list)  # (item, position) of each code
    needed: list[int] = field(default_factory=list)

    @staticmethod
    def of(ids: list[int], texts: list[str]) -> Block:
        vocabulary: dict[str, int] = {}
        words = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(t)], np.int64) for t in texts]
        return Block(ids, words, vocabulary)

    def code(self, ids: np.ndarray) -> np.ndarray:
        """A number for each run of ``GRAM`` known words; -1 where a word is unknown."""
        n = max(0, len(ids) - GRAM + 1)
        made, known = np.zeros(n, np.int64), np.ones(n, bool)
        for at in range(GRAM):
            made = made * (len(self.vocabulary) + 1) + ids[at:at + n]
            known &= ids[at:at + n] > 0
        return np.where(known, made, -1)

    def seed(self, frequency: np.ndarray) -> None:
        """Choose seeds, given the corpus frequency of each word of the vocabulary."""
        rarity, found = np.log(frequency + 1.0), {}
        for item, ids in enumerate(self.words):
            codes = self.code(ids)
            weight = np.convolve(rarity[ids], np.ones(GRAM), "valid") if len(codes) else codes
            chosen = {int(a + np.argmin(weight[a:a + SLICE])) for a in range(0, len(codes), SLICE)}
            for position in chosen:
                found.setdefault(int(codes[position]), []).append((item, position))
            self.needed.append(min(2, len({int(codes[p]) for p in chosen})))
        self.codes = np.array(sorted(found), np.int64)
        self.owners = [found[code] for code in self.codes.tolist()]

    def hits(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, last word exclusive) of the items found in a text."""
        words = words_of(text)
        if len(words) < GRAM or not len(self.codes):
            return []
        ids = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        codes = self.code(ids)
        places = np.flatnonzero(codes >= 0)
        slot = np.minimum(np.searchsorted(self.codes, codes[places]), len(self.codes) - 1)
        same = self.codes[slot] == codes[places]
        met: dict[int, list[tuple[int, int]]] = {}
        for place, at in zip(places[same].tolist(), slot[same].tolist(), strict=True):
            for item, position in self.owners[at]:
                met.setdefault(item, []).append((place - position, at))
        found = []
        for item, diagonals in met.items():
            if best := self._best(item, sorted(diagonals), ids):
                found.append((item, *best))
        return found

    def _best(self, item: int, diagonals: list[tuple[int, int]], ids: np.ndarray) -> tuple[float, int, int] | None:
        wanted, size = self.words[item], len(self.words[item])
        slack, best, first = size // 3 + 2, None, 0
        for last in range(1, len(diagonals) + 1):
            if last < len(diagonals) and diagonals[last][0] - diagonals[last - 1][0] <= slack:
                continue
            group = diagonals[first:last]
            first = last
            if len({seed for _, seed in group}) < self.needed[item]:
                continue
            low, high = max(0, group[0][0] - slack), min(len(ids), group[-1][0] + size + slack)
            score, _, end = align(wanted, ids[low:high])
            share = score / (MATCH * size)
            if share >= SCORE and score >= MATCH * min(size, WORDS) and (best is None or share > best[0]):
                best = share, max(low, low + end - size), low + end
        return best


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items, block by block; a block is bounded and goes through the driver."""
    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = size // BLOCK_BYTES + 1
    for at in range(number):
        table = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == at).toArrow().sort_by("item_id")
        if len(table):
            yield Block.of(table["item_id"].to_pylist(), table["text"].to_pylist())


def frequencies(docs: DataFrame, block: Block) -> np.ndarray:
    """How often each word of the block's vocabulary occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        counts = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ids = [vocabulary.get(w, 0) for w in words_of(text)]
                counts += np.bincount(np.array(ids, np.int64), minlength=len(counts))
        used = np.flatnonzero(counts[1:]) + 1
        yield pa.RecordBatch.from_pydict({"word": used, "n": counts[used]})

    table = docs.select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(len(block.vocabulary) + 1)
    found[table["word"].to_numpy()] = table["n"].to_numpy()
    return found


def _with_blocks(docs: DataFrame, benchmark: DataFrame, apply: Callable) -> list:
    made = []
    for block in blocks(benchmark):
        block.seed(frequencies(docs, block))
        made.append(apply(docs.sparkSession.sparkContext.broadcast(block)))
    return made


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): every item found in a document, at its best place."""
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(sent):
        def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                found = [
                    (doc_id, block.ids[item], score, low, high)
                    for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for item, score, low, high in block.hits(text)]
                columns = list(zip(*found, strict=True)) or [()] * 5
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["doc_id", "item_id", "score", "first_word", "last_word"])

        return rows.mapInArrow(batchwise, schema)

    found = docs.sparkSession.createDataFrame([], schema)
    for part in _with_blocks(rows, benchmark, search):
        found = found.union(part)
    best = F.max(F.struct("score", -F.col("first_word"), "last_word")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.round("b.score", 4).alias("score"), (-F.col("b.col2")).alias("first_word"), F.col("b.last_word").alias("last_word"))


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any item, with all their columns."""
    at = docs.columns.index("text")

    def without(sent):
        def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch in batches:
                keep = [not block.hits(text) for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return lambda frame: frame.mapInArrow(batchwise, docs.schema)

    clean = docs
    for step in _with_blocks(docs, benchmark, without):
        clean = step(clean)
    return clean
