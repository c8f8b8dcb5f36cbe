"""Token counts without token ids: pieces are counted once per distinct pre-token.

A pre-token is a run of spaces with the characters that follow, or a line feed. The vocabulary has no piece that
continues past such a place (checked when the model is loaded), so the pieces of a text are those of its pre-tokens.
First pass: corpus counts of pre-tokens, grouped, and the pieces of each distinct one. Second pass: pre-token
frequencies per document. Pre-tokens frequent enough to be among the first ``HEAD`` (a fixed number of short strings,
found from the histogram of counts) travel to the tasks and are summed where the document is read; all others are
joined to the counted table, which is kept in compressed files. No pre-token is left out, and the split moves no count.

Rows are told apart by doc_id and length and, where ids repeat or are missing, a 64-bit hash of the text; rows equal in
all are copies of one text, have equal counts and each come back. Null text counts as empty: 0 bytes, 0 tokens. Texts of
any length are cut into pre-tokens as a whole; one without spaces is a single pre-token. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import release, stored, whole_text

SPACE = "▁"  # how the model writes a space
PRE_TOKEN = re.compile(f"[ {SPACE}]+[^ {SPACE}\n]*|[^ {SPACE}\n]+|\n")
HEAD = 300_000
HEAD_CHARACTERS = 40
_FLUSH = 400_000


@cache
def processor(path: str):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    for at in range(model.get_piece_size()):
        piece = model.id_to_piece(at)
        if SPACE in piece.lstrip(SPACE) or "\n" in piece:
            raise ValueError(f"piece {piece!r} of {path} crosses a pre-token boundary")
    return model


def pre_tokens(text: str) -> list[str]:
    """In order; the model puts one space before a text that is not empty."""
    return PRE_TOKEN.findall(f" {text}") if text else []


def piece_counts(path: str, tokens: list[str]) -> list[int]:
    """Behind a line feed no space is put before a pre-token; the line feed's own pieces are taken off."""
    model = processor(path)
    mark = len(model.encode("\n"))
    return [len(ids) - mark for ids in model.encode([f"\n{token}" for token in tokens], num_threads=1)]


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        made = pa.RecordBatch.from_pydict({"token": list(counts.keys()), "n": pa.array(counts.values(), pa.int64())})
        counts.clear()
        return made

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(pre_tokens(text))
            if len(counts) > _FLUSH:
                yield flush()
    if counts:
        yield flush()


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(token, n, pieces) of every distinct pre-token of the corpus."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = pa.array(piece_counts(path, batch.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pieces], ["token", "n", "pieces"])

    found = docs.select(whole_text().alias("text")).mapInArrow(_corpus_counts, "token string, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n")).mapInArrow(counted, "token string, n long, pieces long")


def head_of(words: DataFrame, size: int) -> dict[str, int]:
    """Pieces of the most frequent short pre-tokens, at most ``size`` of them."""
    short = words.where(F.char_length("token") <= HEAD_CHARACTERS)
    step = F.floor(F.log("n") / math.log(1.2)).cast("int").alias("step")
    total, least = 0, None
    for row in sorted(short.groupBy(step).count().collect(), key=lambda r: -r.step):
        total += row["count"]
        if total > size:
            break
        least = row.step
    if least is None:
        return {}
    table = short.where(step >= least).select("token", "pieces").toArrow()
    return dict(zip(table["token"].to_pylist(), table["pieces"].to_pylist(), strict=True))


def _frequencies(head: Callable[[], dict[str, int]]):
    """Per row: the pieces of its frequent pre-tokens under a mark, and its other pre-tokens with their frequencies.

    A mark is a line feed with a number behind it, which no pre-token is; the number spreads the rows' marks.
    """

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = head().get
        for batch in batches:
            tokens, counts, ends = [], [], [0]
            for text, content in zip(batch.column("text").to_pylist(), batch.column("content").to_pylist(), strict=True):
                known, at = 0, len(tokens)
                tokens.append(f"\n{(len(text) * 31 + content) & 0xFFF:x}")
                counts.append(0)
                for token, n in Counter(pre_tokens(text)).items():
                    if (pieces := pieces_of(token)) is None:
                        tokens.append(token)
                        counts.append(n)
                    else:
                        known += n * pieces
                counts[at] = known
                ends.append(len(tokens))
            entries = pa.StructArray.from_arrays(
                [pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], ["token", "n"])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)],
                ["doc_id", "content", "n_bytes", "entries"])

    return batchwise


def token_counts(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, for the model file at ``path``."""
    words = stored(vocabulary(docs, path), "pre-tokens")
    sent = docs.sparkSession.sparkContext.broadcast(head_of(words, head))
    release(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    told_apart = ids.where("n > 1 OR doc_id IS NULL").isEmpty()
    content = F.lit(0).cast("long") if told_apart else F.xxhash64(whole_text())
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), content.alias("content"),
        F.octet_length(whole_text()).cast("long").alias("n_bytes"), whole_text().alias("text"))
    parts = rows.mapInArrow(
        _frequencies(lambda: sent.value),
        "doc_id long, content long, n_bytes long, entries array<struct<token string, n long>>").select(
        "doc_id", "content", "n_bytes", F.inline("entries"))
    own = F.col("token").startswith("\n") & (F.col("token") != "\n")
    # Sorted and merged: the files are so much smaller than the table that their size would allow a broadcast too soon.
    summed = parts.join(words.select("token", "pieces").hint("merge"), "token", "left").groupBy("doc_id", "content", "n_bytes").agg(
        F.sum(F.when(own, F.col("n")).otherwise(F.col("n") * F.col("pieces"))).alias("tokens"), F.count_if(own).cast("int").alias("copies"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return summed.select("doc_id", "n_bytes", F.expr("tokens div copies").alias("n_tokens"), copy).drop("copy")
