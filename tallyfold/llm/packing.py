"""Mixture-controlled packing of documents into training sequences.

Every document is its ids with an end id. Ids are made once and kept in the shared checkpoint folder. Documents are
dealt by hash into blocks of about ``BLOCK_TOKENS`` ids, whatever the source, so a source with a third of all rows is
spread over all blocks. The hash is over ``doc_id`` and the ids, and for rows without ``doc_id`` over their place too,
which is stored with them; so neither missing nor repeated ids, nor copies without one, meet in one block. Only rows with the same ``doc_id`` and
the same text do. The blocks form one gapless stream of windows of ``length`` ids: how many ids of each source
come before a block follows from sums over (block, source), and so do the window where the block starts and the
deficit each source carries into it (target share of all ids so far, less what it has had). Within a block the
sources are queues. Each window adds the target shares to the deficits and serves the queue with the largest
deficit, at least ``QUANTUM`` ids at a time, until it is full; what a source lacks is carried to the next window and,
through the sums, to the next block. Documents are cut where a turn or a window ends. Only the last sequence can be
short.

Target shares are the sources' shares of all ids unless ``mixture`` names weights; every id is used in any case, so
once a queue is empty the others take its turns.

Null text is empty (just the end id), null source is the source ''. Rows repeated with one ``doc_id`` are packed
each. Documents of any length are cut over as many windows as they need. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import checkpointed, held, whole_text

LENGTH = 2048
QUANTUM = 256
BLOCK_TOKENS = 1 << 19
BLOCKS_SUMMED = 1024
_CACHED_WORDS = 400_000
#: Letters, and behind them up to eight signs that cannot begin a contraction or a special token.
_LETTERS_AND_SIGNS = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:;=>?@\[-`{-~]{0,8})")
#: Byte-level alphabet (fixed): printable bytes stand for themselves, the others for characters from 256 on.
_OTHER_BYTES = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_BYTE_LETTERS = {byte: 256 + at for at, byte in enumerate(_OTHER_BYTES)}


class WordIds(dict):
    """Ids of words between spaces, as bytes; made on first use and forgotten when there are too many.

    The tokenizer never joins characters across white space, so the ids of a text are those of its words. Nor does it
    join letters and signs: a word of Latin letters with signs behind is two pre-tokens, and the letters go straight
    to the model. Any other word takes the whole way. Spellings of one word are kept from their second use on.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.type_code = "H" if self.dtype == "<u2" else "I"
        self.signs: dict[str, bytes] = {"": b""}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        split = _LETTERS_AND_SIGNS.fullmatch(word.lower())
        if split is None:
            self[word] = made = self._whole(word)
            return made
        letters, signs = split.groups()
        if (tail := self.signs.get(signs)) is None:
            tail = self.signs[signs] = self._whole(signs)
        if (known := self.get(letters)) is None:
            tokens = self.model.tokenize(letters.encode().decode("latin-1").translate(_BYTE_LETTERS))
            known = self[letters] = array(self.type_code, [token.id for token in tokens]).tobytes()
            return known + tail
        self[word] = made = known + tail
        return made

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def of(self, text: str, end: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) + end


def word_ids(path: str) -> WordIds:
    """The ids of words that this worker has met."""
    return held(("word ids", path), lambda: WordIds(path))


def tokenized(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """(source, doc_id, n, ids) of every row; ids are unsigned and as wide as the vocabulary needs."""

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        end, width = np.array([end_id], words.dtype).tobytes(), np.dtype(words.dtype).itemsize
        for batch in batches:
            ids = [words.of(text, end) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("source"), batch.column("doc_id"), pa.array([len(i) // width for i in ids], pa.int64()),
                 pa.array(ids, pa.binary())], ["source", "doc_id", "n", "ids"])

    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    return docs.select(source, F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        batchwise, "source string, doc_id long, n long, ids binary")


def _before(sizes: DataFrame, *keys: str) -> DataFrame:
    """(keys, block, n, before): the sum of n over earlier blocks, by sums over runs of blocks and then within one."""
    run = F.floor(F.col("block") / BLOCKS_SUMMED).alias("run")
    sizes = sizes.groupBy(*keys, "block").agg(F.sum("n").alias("n")).select(*keys, "block", "n", run)
    ahead = F.coalesce(F.sum("n").over(
        Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sizes.groupBy(*keys, "run").agg(F.sum("n").alias("n")).select(*keys, "run", ahead.alias("ahead"))
    within = F.coalesce(F.sum("n").over(
        Window.partitionBy(*keys, "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("within", within).join(runs, [*keys, "run"]).select(
        *keys, "block", "n", (F.col("ahead") + F.col("within")).alias("before"))


def carried(tokens: DataFrame, mixture: dict[str, float] | None) -> DataFrame:
    """(block, source, block_start, share, deficit) of every source in every block."""
    sizes = checkpointed(tokens.groupBy("block", "source").agg(F.sum("n").alias("n")))
    totals = sizes.groupBy("source").agg(F.sum("n").cast("double").alias("weight"))
    if mixture is not None:
        known = F.create_map(*(F.lit(x) for pair in mixture.items() for x in pair)) if mixture else None
        weight = F.coalesce(known[F.col("source")], F.lit(0.0)) if mixture else F.lit(0.0)
        totals = totals.withColumn("weight", weight.cast("double"))
    whole = totals.agg(F.sum("weight")).first()[0] or 1.0
    starts = _before(sizes).select("block", F.col("before").alias("block_start"))
    return _before(sizes, "source").join(starts, "block").join(totals, "source").select(
        "block", "source", "block_start", (F.col("weight") / whole).alias("share"),
        (F.col("weight") / whole * F.col("block_start") - F.col("before")).alias("deficit"))


class Queue:
    """The documents of one source in a block, and how far they have been served."""

    def __init__(self, share: float, deficit: float):
        self.share, self.deficit, self.documents, self.left = share, deficit, [], 0
        self.at = self.start = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.documents.append((doc_id, ids, len(ids) // 4))
        self.left += len(ids) // 4

    def pieces(self, wanted: int) -> Iterator[tuple]:
        self.left -= wanted
        self.deficit -= wanted
        while wanted:
            doc_id, ids, n = self.documents[self.at]
            length = min(wanted, n - self.start)
            yield doc_id, self.start, length, ids[4 * self.start:4 * (self.start + length)], n
            wanted -= length
            self.start += length
            if self.start == n:
                self.at, self.start = self.at + 1, 0


def served(queues: list[Queue], position: int, length: int, quantum: int) -> Iterator[tuple]:
    """(global position, piece) until all queues are empty."""
    waiting = [queue for queue in queues if queue.left]
    while waiting:
        room = length - position % length
        total = sum(queue.share for queue in waiting)
        for queue in waiting:
            queue.deficit += room * (queue.share / total if total else 1 / len(waiting))
        while room and waiting:
            queue = max(waiting, key=lambda q: q.deficit)
            turn = min(queue.left, room, max(quantum, int(queue.deficit)))
            for piece in queue.pieces(turn):
                yield position, piece
                position += piece[2]
            room -= turn
            if not queue.left:
                waiting.remove(queue)


def dealt(tokens: DataFrame, blocks: int) -> DataFrame:
    """Tokenized rows with the block of each."""
    return tokens.withColumn("block", F.pmod(F.xxhash64("doc_id", "ids", "place"), F.lit(blocks))).drop("place")


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)


def packed(
    docs: DataFrame, path: str, length: int = LENGTH, quantum: int = QUANTUM,
    mixture: dict[str, float] | None = None, end_id: int = 1, with_ids: bool = False,
) -> DataFrame:
    """One row per piece; ``ids`` (unsigned 32-bit, little-endian) are filled in on request."""
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    tokens = checkpointed(tokenized(docs, path, end_id).withColumn("place", place))
    blocks = (tokens.agg(F.sum("n")).first()[0] or 0) // BLOCK_TOKENS + 1
    tokens = dealt(tokens, blocks)
    dtype = word_ids(path).dtype

    def pack(documents: pa.Table, carry: pa.Table) -> pa.Table:
        queues, position = {}, 0
        for row in carry.sort_by("source").to_pylist():
            queues[row["source"]] = Queue(row["share"], row["deficit"])
            position = row["block_start"]
        ordered = documents.sort_by([("source", "ascending"), ("doc_id", "ascending"), ("ids", "ascending")])
        for source, doc_id, ids in zip(*(ordered[c].to_pylist() for c in ("source", "doc_id", "ids")), strict=True):
            queues[source].add(doc_id, np.frombuffer(ids, dtype).astype("<u4").tobytes())
        rows = [
            (doc_id, start, n, zlib.crc32(ids), whole, at // length, at % length, ids if with_ids else None)
            for at, (doc_id, start, n, ids, whole) in served(list(queues.values()), position, length, quantum)]
        names = [*(part.split()[0] for part in PIECES.split(", "))]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        types = [pa.int64()] * 7 + [pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    carry = carried(tokens, mixture).toDF("of_block", "source", "block_start", "share", "deficit")
    made = tokens.groupBy("block").cogroup(carry.groupBy("of_block")).applyInArrow(pack, PIECES)
    return made if with_ids else made.drop("ids")
