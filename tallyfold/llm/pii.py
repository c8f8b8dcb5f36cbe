"""Personal data in whole texts: exact base patterns, and candidates chosen by boosted trees.

Four base patterns (e-mail, IPv4 address, payment card, phone) are always reported. High-recall generators propose
further spans, which overlap: from each group of digits, every run of whole groups that could be an IPv4 address (four
short groups), a card (13 to 19 digits) or a phone (7 to 15), with up to six signs of noise between groups and no
limit on the length of the text around them; and spelled-out addresses. Gradient-boosted trees score a candidate by
its format and its surroundings. They learn from every text: the generators' own finds, labelled by whether a base
pattern reports the same span, and copies of the base finds with noise put between the groups, which keep their label,
while other spans inside such a copy do not; finds that a base pattern would report without their noise are not held
against the model. Features take few values (``level``), so equal examples are counted where they arise and once more
over all tasks, and the trees learn from the distinct ones, weighted by their counts (both labels weigh the same).
``BINS`` is wide enough for Spark to look for splits among a million distinct examples. Each level of each tree is a
shuffle of sums whose size goes with the number of tasks, so the distinct examples are dealt out by their number
(``PER_TASK``), whatever the number of shuffle partitions, and a model's shuffles are deleted before the next one.

The texts are in two halves, by hash. A model of each half scores the other, so every example has a score of a model
that has not seen its text; from these scores comes one threshold per kind: half-way below the lowest score down to
which the smoothed precision over all examples is ``PRECISION``. The model of all examples scores the candidates. Of
those that reach the threshold and overlap no base span, the best scored of those that overlap each other is added
(ties: the earlier, then the longer).

Base spans, candidates, scores and the choice are narrow steps over each partition, in the order of the text: nothing
but the counted examples is shuffled or stored, and a text's candidates pass in bounded batches.

Spans are code points, end exclusive. Null text is empty: no spans. Rows repeated with one ``doc_id`` each come back.
Without both labels in both halves no model is trained and only base spans are reported. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil, log2

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import checkpointed, release, whole_text

KINDS = ["email", "ip", "card", "phone"]
PRECISION = 0.95
ROUNDS = 20
DEPTH = 4
LEAF = 10
BINS = 1024
STEPS = 10_000
PER_TASK = 5_000

#: Base patterns (fixed); quantifiers that cannot give back keep the search linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Generators: digit groups with noise between them, and addresses with the signs spelled out or spaced.
GROUP = re.compile("[0-9]+")
GAP = re.compile(r"[^0-9A-Za-z\n]{1,6}")
IP_GROUPS, CARD_DIGITS, PHONE_DIGITS = 4, (13, 19), (7, 15)
SPELLED = re.compile(
    r"[\w.%+-]{1,64}\s{0,2}(?:@|[\[(]\s?at\s?[\])])\s{0,2}[\w-]{1,63}"
    r"(?:\s{0,2}(?:\.|[\[(]\s?dot\s?[\])])\s{0,2}[\w-]{1,63}){1,6}", re.I)
_SIGN = re.compile(r"@|[\[(]\s?at\s?[\])]", re.I)
_HEAD = re.compile(r"\+[^0-9A-Za-z\n+]{0,2}\Z|\(\Z")
_WORTH = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]", re.I)
NOISE = ["!! ", " | ", "*** ", " / "]
WORDS_BEFORE = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "fax", "mobile"),
}


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts where the run before its sign starts, or where the address before it ends."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        groups = m[0].split(".")
        if len(groups) == 4 and all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in groups):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


def is_part(group: str) -> bool:
    """Whether digits can be one part of an IPv4 address."""
    short = group.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def number_runs(text: str) -> Iterator[tuple[int, int, int]]:
    """From each group of digits, all runs of whole groups whose digits fit a kind; at most 19 groups each."""
    groups = [m.span() for m in GROUP.finditer(text)]
    parts = [b - a <= 40 and is_part(text[a:b]) for a, b in groups]
    linked = [b - a <= 6 and GAP.fullmatch(text, a, b) is not None
              for (_, a), (b, _) in zip(groups, groups[1:], strict=False)] + [False]
    for first, (start, _) in enumerate(groups):
        head = _HEAD.search(text, max(0, start - 3), start)
        dialled = start if head is None else head.start()
        if dialled == start - 1 and text[dialled] == "(" and text[dialled - 1:dialled] == "+":
            dialled -= 1
        digits = 0
        for last in range(first, len(groups)):
            end = groups[last][1]
            digits += end - groups[last][0]
            if last - first + 1 == IP_GROUPS and all(parts[first:last + 1]):
                yield 1, start, end
            if CARD_DIGITS[0] <= digits <= CARD_DIGITS[1]:
                yield 2, start, end
            if PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1]:
                yield 3, dialled, end
            if not linked[last] or digits > CARD_DIGITS[1] and last - first + 1 >= IP_GROUPS:
                break


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """Overlapping candidates of every kind that a place could be."""
    yield from number_runs(text)
    if _SIGN.search(text):
        yield from ((0, *m.span()) for m in SPELLED.finditer(text))


def level(n: int) -> float:
    """A number as it is up to 24, then the nearest lower of eight steps per doubling."""
    return float(n if n <= 24 else 24 + int(8 * log2(n / 24)))


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and what surrounds it."""
    span, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 24]
    digits = digits_of(span)
    groups = re.findall("[0-9]+", span)
    others = re.sub(r"[0-9A-Za-z]", "", span)
    near = before + after
    return [
        *(float(kind == k) for k in range(4)), level(len(digits)), level(end - start), level(len(others)),
        level(len(set(others))), level(len(groups)), level(max(map(len, groups), default=0)),
        float(span.startswith("+")), float("(" in span), float(luhn(digits) if digits else 0),
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        level(span.count(".")), level(span.count("@")), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(before[-1:] in ".-+_=\""), float(len(set(digits))),
        16 * sum(c.isdigit() for c in near) // (len(near) + 1) / 16,
        float(any(word in before.lower() for word in WORDS_BEFORE[KINDS[kind]])),
    ]


def tidied(span: str) -> str:
    """A span without noise, its signs written out."""
    span = re.sub(r"\s*[\[(]\s?at\s?[\])]\s*", "@", span, flags=re.I)
    span = re.sub(r"\s*[\[(]\s?dot\s?[\])]\s*", ".", span, flags=re.I)
    span = re.sub(r" {2,}", " ", re.sub(r"[^0-9A-Za-z+@.()_% -]+", "", span))
    return re.sub(r" *\. *", ".", span)


def without_noise(kind: int, span: str) -> bool:
    """Whether a base pattern would report the kind were it not for the noise."""
    return any(found == kind for found, _, _ in base_spans(tidied(span)))


def noisy_copies(text: str, kind: int, start: int, end: int) -> Iterator[tuple[int, list[float], float]]:
    """(kind, features, label) of a base find after noise was put between its groups, and of other spans inside."""
    span = text[start:end]
    for noise in NOISE:
        if kind == 0:
            noised = span.replace("@", f"{noise[:-1]}@", 1) if noise == NOISE[1] else span.replace("@", " [at] ", 1)
        else:
            noised = re.sub(r"[ .)(-]+", lambda m, n=noise: m[0].strip() + n, span[1:-1]) if len(span) > 2 else span
            noised = span[0] + noised + span[-1]
        shifted = text[max(0, start - 24):start] + noised + text[end:end + 24]
        at = min(start, 24)
        own = kind, at, at + len(noised)
        yield kind, features(shifted, *own), 1.0
        if kind:
            for other, a, b in number_runs(shifted):
                if a < own[2] and b > own[1] and (other, a, b) != own and not without_noise(other, shifted[a:b]):
                    yield other, features(shifted, other, a, b), 0.0


N_FEATURES = 22
BATCH = 2_000
_ENTRY = pa.schema([
    ("doc_id", pa.int64()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
    ("features", pa.list_(pa.float64())), ("base", pa.list_(pa.list_(pa.int64())))])
ENTRY = "doc_id long, kind int, start long, end long, features array<double>, base array<array<long>>"
HELD = 20_000
_EXAMPLE = pa.schema([
    ("half", pa.int32()), ("kind", pa.int32()), ("features", pa.list_(pa.float64())), ("label", pa.float64()), ("n", pa.int64())])
EXAMPLE = "half int, kind int, features array<double>, label double, n long"


def merged(spans: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the sorted, disjoint stretches that the spans cover."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def overlaps(taken: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether a stretch meets [start, end)."""
    at = bisect_right(taken[1], start)
    return at < len(taken[0]) and taken[0][at] < end


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Proposals clear of the base spans."""
    taken = merged((a, b) for _, a, b in base)
    return (span for span in proposals(text) if not overlaps(taken, *span[1:]))


def examples(text: str) -> Iterator[tuple[int, list[float], float]]:
    """(kind, features, label) to learn from."""
    base = base_spans(text)
    known = set(base)
    for span in proposals(text):
        if span in known:
            yield span[0], features(text, *span), 1.0
        elif not without_noise(span[0], text[span[1]:span[2]]):
            yield span[0], features(text, *span), 0.0
    for span in base:
        yield span[0], features(text, *span), 1.0
        yield from noisy_copies(text, *span)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size."""
    from itertools import batched

    for some in batched(rows, BATCH):
        columns = zip(*some, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, field.type) for c, field in zip(columns, schema, strict=True)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[str]:
    for batch in batches:
        yield from batch.column(column).to_pylist()


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct examples and their counts, passed on whenever ``HELD`` have come together."""

    def rows() -> Iterator[tuple]:
        counts = Counter()
        for text in _texts(batches, "text"):
            if not _WORTH.search(text):
                continue
            half = zlib.crc32(text.encode()) >> 16 & 1
            for kind, found, label in examples(text):
                counts[half, kind, tuple(found), label] += 1
                if len(counts) >= HELD:
                    yield from ((*key, n) for key, n in counts.items())
                    counts.clear()
        yield from ((*key, n) for key, n in counts.items())

    return _batches(rows(), _EXAMPLE)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of each text, then one row of kind -1 with its base spans."""
    none = [0.0] * N_FEATURES

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base = base_spans(text) if _WORTH.search(text) else []
                if _WORTH.search(text):
                    for kind, start, end in candidates(text, base):
                        yield doc_id, kind, start, end, features(text, kind, start, end), None
                yield doc_id, -1, None, None, none, base

    return _batches(rows(), _ENTRY)


def chosen(scored: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """Of candidates (score, kind, start, end) that overlap, the best scored; ties: the earlier, the longer, the kind."""
    starts, ends, out = [], [], []
    for _, kind, a, b in sorted(scored, key=lambda s: (-s[0], s[2], -s[3], s[1])):
        at = bisect_left(ends, a + 1)
        if at == len(starts) or starts[at] >= b:
            insort(starts, a)
            insort(ends, b)
            out.append((kind, a, b))
    return out


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest columns of each row from its base spans and the candidates before them."""

    def rows() -> Iterator[tuple]:
        waiting = []
        for batch in batches:
            for doc_id, kind, start, end, p, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind >= 0:
                    waiting.append((p, kind, start, end))
                    continue
                base, added = sorted(map(tuple, base)), chosen(waiting)
                waiting = []
                joined, whole = (",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in s) for s in (base, sorted([*base, *added])))
                counts = [sum(span[0] == k for span in base) for k in range(len(KINDS))]
                yield doc_id, *counts, hashlib.sha256(joined.encode()).hexdigest(), whole, len(added)

    return _batches(rows(), _REPORT)


_REPORT = pa.schema([
    ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()),
    ("spans", pa.string()), ("n_added", pa.int64())])
REPORT = "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_added long"


def trained(examples_: DataFrame):
    """Boosted trees of weighted distinct examples, or None unless there are both labels."""
    totals = dict(examples_.groupBy("label").agg(F.sum("n")).collect())
    if len(totals) < 2:
        return None
    whole = sum(totals.values())
    weight = F.col("n") * F.when(F.col("label") == 1, whole / totals[1.0]).otherwise(whole / totals[0.0])
    least = min(0.49, LEAF / whole)
    trees = GBTClassifier(
        maxIter=ROUNDS, maxDepth=DEPTH, minWeightFractionPerNode=least, maxBins=BINS, weightCol="weight", seed=7)
    return trees.fit(examples_.withColumn("weight", weight))


def thresholds_of(scored: DataFrame) -> list[float]:
    """Per kind, from ``kind, label, p, n`` of all examples, counted in ``STEPS`` steps of the score."""
    counted = scored.groupBy("kind", F.floor(F.col("p") * STEPS).alias("step")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right"), F.min("p").alias("low"),
        F.max("p").alias("high")).collect()
    thresholds = []
    for kind in range(len(KINDS)):
        lowest, right, seen = 2.0, 0.0, 0.0
        falling = sorted((r for r in counted if r["kind"] == kind), key=lambda r: -r["step"])
        for at, r in enumerate(falling, 1):
            seen += r["n"]
            right += r["right"]
            if (right + 1) / (seen + 2) >= PRECISION:
                lowest = (r["low"] + (falling[at]["high"] if at < len(falling) else 0.0)) / 2
        thresholds.append(max(lowest, 0.5))
    return thresholds


def fitted(texts: DataFrame):
    """The model of all texts and a threshold per kind, or None."""
    spark = texts.sparkSession
    counted = checkpointed(texts.mapInArrow(_examples, EXAMPLE).groupBy("half", "kind", "features", "label").agg(
        F.sum("n").alias("n")).withColumn("features", array_to_vector("features")))
    counted = counted.coalesce(max(1, ceil(counted.count() / PER_TASK)))
    halves, models = [counted.where(F.col("half") == half) for half in (0, 1)], []
    for half in halves:
        models.append(trained(half))
        release(spark)
    if not all(models):
        return None
    first, second = (
        model.transform(other).select("kind", "label", vector_to_array("probability")[1].alias("p"), "n")
        for model, other in zip(models, halves[::-1], strict=True))
    whole, thresholds = trained(counted), thresholds_of(first.union(second))
    release(spark)
    return whole, thresholds


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: base counts, digest of the base spans, all spans, and how many were added."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = fitted(rows.select("text"))
    if not found:
        score, model = F.lit(0.0), None
        kept = rows.mapInArrow(_entries, ENTRY).where("kind < 0")
    else:
        model, thresholds = found
        score = vector_to_array("probability")[1]
        least = F.element_at(F.array(*map(F.lit, thresholds)), F.greatest(F.col("kind"), F.lit(0)) + 1)
        entries = rows.mapInArrow(_entries, ENTRY).withColumn("features", array_to_vector("features"))
        kept = model.transform(entries).where((F.col("kind") < 0) | (score >= least))
    return kept.select("doc_id", "kind", "start", "end", score.alias("p"), "base").mapInArrow(_reported, REPORT)
