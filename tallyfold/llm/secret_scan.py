"""Secrets in whole texts, told apart by who owns them. Built-in expressions only: no Python runs on executors.

Three base patterns find assignments, access keys and hexadecimal keys; wider patterns propose further candidates
(other prefixes, upper case, assignments with noise between name and value). Positions come from the pieces between
matches: the running sum of their lengths and of the matches' lengths. The hash of each candidate value is aggregated
over the corpus to the number of distinct repositories and owners that carry it, repository by repository first, so a
value that a third of all rows share is summed map-side. A value of ``MANY_OWNERS`` owners or
``MANY_REPOSITORIES`` repositories is a copied example; a wider candidate counts as a secret when it is none and belongs
to one owner, looks live (letters and digits, enough distinct characters) and does
not overlap a base span. Base spans always stay.

Kinds are ``assign``, ``access`` and ``hex``. Spans are code points of the whole match, end exclusive. Null text is
empty: no spans. Null owners and repositories count as one owner and repository. Rows repeated with one ``doc_id`` and
text each come back; they count once in the statistics. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import checkpointed, whole_text

KINDS = ["assign", "access", "hex"]
#: Fixed patterns of the base: (kind, pattern, group of the value, fewest characters of the value).
BASE = [
    ("assign",
     r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
WIDER = [
    ("assign",
     r"""(?i:(password|passwd|pwd|secret|token|api[ _-]?key|access[ _-]?key|credential|bearer|auth))"""
     r"""[^A-Za-z0-9\n]{1,8}([A-Za-z0-9+/_=-]{16,})""", 2, 16),
    ("access", r"\b(?:ASIA[A-Z0-9]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{10,})", 0, 14),
    ("hex", r"\b[0-9A-F]{32,}\b", 0, 32),
]
MANY_OWNERS = 3
MANY_REPOSITORIES = 20
DISTINCT_CHARACTERS = 8


def _matches(text: Column, number: int, kind: str, pattern: str, group: int, fewest: int, base: bool) -> Column:
    """Every match of a pattern in order: code points before it, its own, and its value."""
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(
        F.transform(gaps, F.char_length), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    entries = F.transform(F.filter(zipped, lambda z: z["1"].isNotNull()), lambda z: F.struct(
        F.lit(number).alias("pattern"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"),
        z["0"].alias("gap"), F.char_length(z["1"]).alias("size"), z["2"].alias("value"),
        (F.char_length(z["2"]) >= fewest).alias("fits")))
    return F.when(text.rlike(pattern), entries)


def live_looking(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (distinct >= DISTINCT_CHARACTERS)


def candidates(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """One row per candidate with its span, and one row without span for each row of ``docs`` that has none."""
    text = F.col("text")
    patterns = [(*p, True) for p in BASE] + [(*p, False) for p in WIDER]
    found = F.flatten(F.array_compact(F.array(*(_matches(text, n, *p) for n, p in enumerate(patterns)))))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"), whole_text().alias("text"))
    rows = rows.select("doc_id", "owner", "repository", F.xxhash64("text").alias("content"), F.posexplode_outer(found).alias("at", "e"))
    rows = rows.select("doc_id", "owner", "repository", "content", "at", "e.*")
    key = ["doc_id", "content", "owner", "repository"]
    rows = rows.groupBy(*key, "at", "pattern", "kind", "base", "gap", "size", "value", "fits").agg(
        F.count("*").cast("int").alias("copies"))
    so_far = F.sum(F.col("gap") + F.col("size")).over(
        Window.partitionBy(*key, "pattern").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", so_far.cast("int")).where("at IS NULL OR fits").select(
        *key, "copies", "kind", "base", (F.col("end") - F.col("size")).alias("start"), "end",
        F.sha2("value", 256).alias("hash"), live_looking(F.col("value")).alias("live"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of every candidate value."""
    by_repository = found.where("hash IS NOT NULL").groupBy("hash", "owner", "repository").agg(F.lit(1).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row: base counts, base spans and all spans, how many base or added values are examples or
    live, and the most owners and repositories of one of them (0 without any)."""
    found = checkpointed(candidates(docs, owner, repository))
    known = found.join(ownership(found), "hash", "left")
    key = ["doc_id", "content", "owner", "repository"]
    by_start = Window.partitionBy(*key).orderBy("start", F.desc("base"), "end", "kind")
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(
        by_start.rowsBetween(Window.unboundedPreceding, 0))
    next_base = F.min(F.when(F.col("base"), F.col("start"))).over(
        by_start.rowsBetween(0, Window.unboundedFollowing))
    covered = (F.coalesce(base_end, F.lit(0)) > F.col("start")) | (F.coalesce(next_base, F.col("end")) < F.col("end"))
    copied = (F.col("owners") >= MANY_OWNERS) | (F.col("repositories") >= MANY_REPOSITORIES)
    alone = F.col("live") & (F.col("owners") == 1) & ~copied
    judged = known.withColumn("covered", covered).withColumn("added", ~F.col("base") & alone & ~F.col("covered"))
    span = F.struct("start", "kind", "end")
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    counts = [F.count_if(F.col("base") & (F.col("kind") == n)).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    taken = F.col("base") | F.col("added")
    grouped = judged.groupBy(*key, "copies").agg(
        *counts,
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("of_base"),
        F.array_sort(F.collect_set(F.when(taken, span))).alias("of_all"),
        F.count_if(taken & copied).alias("n_example"),
        *(F.coalesce(F.max(F.when(taken, F.col(c))), F.lit(0)).alias(c) for c in ("owners", "repositories")),
        F.count_if(taken & alone).alias("n_live"))
    return grouped.select(
        "doc_id", *(f"n_{kind}" for kind in KINDS), F.sha2(text_of(F.col("of_base")), 256).alias("base_sha256"),
        text_of(F.col("of_all")).alias("spans"), "n_example", "n_live", "owners", "repositories",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
