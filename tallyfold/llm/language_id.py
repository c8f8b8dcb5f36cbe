"""Language of whole texts by prediction by partial matching over bytes.

Per language a tree of byte contexts up to ``ORDER`` holds how often each byte followed each context in the training
texts. The probability of a byte is its share in the longest context that has seen it; each context that has not
charges its escape probability (symbols seen / (bytes seen + symbols seen)) and hands on to the next shorter one,
down to equal chances. After training the statistics are frozen, so the code length of a byte depends only on
itself and the ``ORDER`` bytes before it, and a text costs the sum over its bytes. The language with the shortest
code wins; the score is its posterior under equal priors.

Before counting, letters A-Z become lower case, white space one byte and digits another; all other bytes stay as they
are. Only contexts seen in training are stored, as sorted numbers with a code length per language, so memory grows
with the distinct grams seen times the number of languages. A byte whose gram no language has seen is charged the
escapes of its context and looked up under the next shorter one. Training texts are those whose ``crc32(doc_id)`` is not 0 modulo ``FOLDS``, with a language; of
each language all rows, or about ``PER_LANGUAGE`` of them chosen by hash where there are more.

``und`` with score 0 is given for null texts, texts without a letter, and when there was nothing to learn from. Ties
go to the first language by name. Rows without ``doc_id`` are never trained on and not held out. Texts of any length
are scored whole. Repeated rows each get their prediction. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm.common import held, unused


ORDER = 3
FOLDS = 5
PER_LANGUAGE = 2_000
SYMBOLS = 256
UNKNOWN = "und"
PAD = b" " * ORDER
_BLOCK = 1 << 18


def _fold_table() -> bytes:
    table = bytearray(range(256))
    table[65:91] = range(97, 123)
    table[48:58] = b"0" * 10
    for white in b"\t\n\x0b\x0c\r":
        table[white] = 32
    return bytes(table)


FOLD = _fold_table()


def held_out() -> Column:
    remainder = F.crc32(F.col("doc_id").cast("long").cast("string")) % FOLDS
    return F.coalesce(remainder == 0, F.lit(False))


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of the training rows, thinned by hash where a language has more than wanted.

    The sizes of the languages go through the driver, as the model later does.
    """
    rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    lang = F.col("lang").cast("string")
    sizes = rows.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).collect()
    if not sizes:
        return rows.select(lang.alias("lang"), "text")
    shares = F.create_map(*(F.lit(x) for row in sizes for x in (row["lang"], min(1.0, per_language / row["n"]))))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(drawn < shares[lang]).select(lang.alias("lang"), "text")


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of texts with padding before each, and where each text starts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + ORDER) - lengths
    data = b"".join(part for text in texts for part in (PAD, text))
    return np.frombuffer(data.translate(FOLD), np.uint8), starts


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each byte with its context, packed into one number."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        for lang in sorted(set(langs)):
            own = [text for text, of in zip(texts, langs, strict=True) if of == lang]
            data, starts = joined(own)
            wide = data.astype(np.uint32)
            codes = np.zeros(max(0, len(data) - ORDER), np.uint32)
            for at in range(ORDER + 1):
                codes = (codes << 8) | wide[at:len(wide) - ORDER + at]
            inside = np.ones(len(data), bool)
            for at in range(1, ORDER + 1):
                inside[starts - at] = False
            grams, counts = np.unique(codes[inside[ORDER:]], return_counts=True)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(grams), pa.string()), "gram": grams.astype(np.int64), "n": counts})


@dataclass(frozen=True)
class Statistics:
    """Frozen counts: for each language the grams (context and byte, as numbers) seen and how often."""

    name: str
    languages: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]
    size: int = SYMBOLS

    def code_lengths(self) -> Tables:
        """Grams, contexts and their bits from order 0 up; a context ends before the byte its grams end with."""
        tables: Tables = []
        for order in range(ORDER + 1):
            own = [_summed(grams & ((1 << 8 * (order + 1)) - 1), counts) for grams, counts in zip(self.grams, self.counts, strict=True)]
            grams = np.unique(np.concatenate([g for g, _ in own])).astype(np.uint32)
            contexts = np.unique(grams >> 8)
            place = np.searchsorted(contexts, grams >> 8)
            escapes = np.zeros((len(contexts), len(own)), np.float32)
            lengths = np.empty((len(grams), len(own)), np.float32)
            shorter = _looked_up(tables, grams, order - 1, len(own))
            for at, (seen, counts) in enumerate(own):
                n = np.zeros(len(grams))
                n[np.searchsorted(grams, seen)] = counts
                total = np.bincount(place, n, len(contexts))
                kinds = np.bincount(place, n > 0, len(contexts))
                charged = np.where(total > 0, np.log2(np.maximum(total + kinds, 1) / np.maximum(kinds, 1)), 0)
                escapes[:, at] = charged
                lengths[:, at] = np.where(n > 0, np.log2(np.maximum((total + kinds)[place], 1) / np.maximum(n, 1)), charged[place] + shorter[:, at])
            tables.append((grams, lengths, contexts, escapes))
        return tables


#: By order: grams, their code lengths by language, contexts, and what leaving each costs.
Tables = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and the sums of their counts."""
    distinct, place = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(place, counts, len(distinct))


def _found(wanted: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each number stands among the sorted ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _looked_up(tables: Tables, codes: np.ndarray, order: int, languages: int) -> np.ndarray:
    """Bits of the last byte of each code after the ``order`` bytes before it, by language."""
    if order < 0:
        return np.full((len(codes), languages), np.log2(SYMBOLS), np.float32)
    grams, lengths, contexts, escapes = tables[order]
    if order < 3:
        codes = codes & np.uint32((1 << 8 * (order + 1)) - 1)
    at, there = _found(codes, grams)
    if there.all() and len(there):
        return lengths[at]
    out = np.empty((len(codes), languages), np.float32)
    out[there] = lengths[at[there]]
    new, place = np.unique(codes[~there], return_inverse=True)
    context, left = _found(new >> np.uint32(8), contexts)
    longer = _looked_up(tables, new, order - 1, languages)
    longer[left] += escapes[context[left]]
    out[~there] = longer[place]
    return out


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Statistics:
    counted = sample(docs, per_language).mapInArrow(_gram_counts, "lang string, gram long, n long")
    table = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toArrow()
    langs, grams, counts = (table[c].to_numpy(zero_copy_only=False) for c in ("lang", "gram", "n"))
    languages = sorted(set(langs))
    return Statistics(
        uuid4().hex, languages, [grams[langs == lang] for lang in languages], [counts[langs == lang] for lang in languages])


def _table(model: Statistics) -> Tables:
    """The tables of the model last used by this worker."""
    return held(model.name, model.code_lengths)


def bits(model: Statistics, texts: list[bytes]) -> np.ndarray:
    """Code length of each text in each language; texts are taken in groups of about ``_BLOCK`` bytes."""
    total, first = np.zeros((len(texts), len(model.languages))), 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= _BLOCK):
            size += len(texts[last])
            last += 1
        total[first:last] = _bits_of_group(model, texts[first:last])
        first = last
    return total


def _bits_of_group(model: Statistics, texts: list[bytes]) -> np.ndarray:
    table, total = _table(model), np.zeros((len(texts), len(model.languages)))
    data, starts = joined(texts)
    ends = np.append(starts[1:] - ORDER, len(data))
    for low in range(ORDER, len(data), _BLOCK):
        high = min(low + _BLOCK, len(data))
        part = data[low - ORDER:high].astype(np.uint32)
        code = part[:high - low].copy()
        for at in range(1, ORDER + 1):
            code <<= 8
            code |= part[at:at + high - low]
        lengths = _looked_up(table, code, ORDER, len(model.languages))
        sums = np.vstack([np.zeros(len(model.languages)), np.cumsum(lengths, axis=0, dtype=np.float64)])
        begin, end = np.clip(starts, low, high) - low, np.clip(ends, low, high) - low
        total += sums[np.maximum(begin, end)] - sums[begin]
    return total


def predicted(docs: DataFrame, model: Statistics) -> DataFrame:
    """All columns and rows of ``docs``, and behind them ``_language`` and ``_score`` (or such names not yet taken)."""
    language, score_name, letter = (unused(name, docs) for name in ("_language", "_score", "_has_letter"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics = sent.value
        names = np.array([*statistics.languages, UNKNOWN], object)
        for batch in batches:
            has_letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if len(names) > 1 and len(texts):
                lengths = bits(statistics, texts)
                shortest = lengths.argmin(axis=1)
                ratio = np.exp2(np.maximum(lengths.min(axis=1, keepdims=True) - lengths, -1000.0))
                best, score = np.where(has_letter, shortest, best), np.where(has_letter, 1 / ratio.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)],
                [*batch.schema.names[:-1], language, score_name])

    schema = T.StructType([*docs.schema.fields, T.StructField(language, T.StringType()), T.StructField(score_name, T.DoubleType())])
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(letter, has_letter).mapInArrow(batchwise, schema)


def recognised_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows whose language is known, with all their columns."""
    labelled = predicted(docs, learned(docs, per_language))
    return labelled.where(F.col(labelled.columns[-2]) != UNKNOWN).select(docs.columns)


def languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; neither doc_id nor lang is seen by the prediction."""
    model = learned(docs, per_language)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predicted(rows, model).select(
        "doc_id", "held_out", F.col("_language").alias("lang_pred"), F.col("_score").alias("score"))
