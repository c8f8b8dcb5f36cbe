"""Comparison of many result tables at once, and the search for the columns a wider result answers with.

The results of all questions lie in two tables with one row per result row: ``qid``, ``at`` (its place) and ``cells``, an
array of ``struct<number double, text string>`` (both missing for NULL). What a pair of results needs is decided for all
pairs in the same few jobs: row counts, column alignment, candidate column choices, positions, the first mismatch. No
job belongs to one pair, and no pair is held by one task.

A prediction with more columns than gold may answer with any choice of them. Choices are not tried one by one: the
rows are summed up into fingerprints of columns and of pairs of columns (sums of products, hashes of text, common
nulls, with bounds for what the tolerance can move them by), and a search over these small tables keeps the choices
whose single columns and pairs of columns all may match. Columns equal in every row stand for each other, so only one
order of them is kept. What is left, nearly always one choice, is compared exactly, ``WAVE`` choices of every question at
a time, until each question has a match or no choice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.compare import (
    ABSOLUTE_TOLERANCE,
    ORDER_DECIMALS,
    RELATIVE_TOLERANCE,
    Order,
    cells_agree,
    facing,
    is_number,
    normal_cell,
    tolerance,
)
from tallyfold.session import shared_folder

WAVE = 16
ROWS_PER_TASK = 100_000
# Fixed value: characters of an error or reason that a log keeps.
REASON_LENGTH = 200
CELL = "struct<number: double, text: string>"


def cells_of(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The normalized cells of the rows of a table, as one array."""
    made = []
    for name in columns or df.columns:
        field = df.schema[name]
        number = is_number(field.dataType)
        made.append(F.struct(
            (normal_cell(field) if number else F.lit(None).cast("double")).alias("number"),
            (F.lit(None).cast("string") if number else normal_cell(field)).alias("text")))
    return F.array(*made)


def _missing(cell: Column) -> Column:
    return cell["number"].isNull() & cell["text"].isNull()


def _cell_agrees(gold: Column, pred: Column) -> Column:
    both_numbers = gold["number"].isNotNull() & pred["number"].isNotNull()
    both_texts = gold["text"].isNotNull() & pred["text"].isNotNull()
    return (
        (_missing(gold) & _missing(pred))
        | (both_numbers & cells_agree(gold["number"], pred["number"], True, True))
        | (both_texts & cells_agree(gold["text"], pred["text"], False, False)))


def _joint(a: Column, b: Column) -> list[Column]:
    """What two cells of a row add to the fingerprint of their columns: kinds and nulls, a hash of text, a number, its slack."""
    def kind(cell: Column) -> Column:
        return F.when(cell["number"].isNotNull(), 1).when(cell["text"].isNotNull(), 2).otherwise(0)

    def weight(cell: Column) -> Column:
        """A number stands for itself, text and NULL for a small number made from the text."""
        return F.coalesce(cell["number"], F.pmod(F.xxhash64(F.coalesce(cell["text"], F.lit(""))), F.lit(1009)).cast("double"))

    def slack(cell: Column) -> Column:
        return F.when(cell["number"].isNotNull(), 2 * tolerance(cell["number"])).otherwise(0.0)

    product = weight(a) * weight(b)
    moved = F.abs(weight(a)) * slack(b) + F.abs(weight(b)) * slack(a) + slack(a) * slack(b) + F.abs(product) * 1e-12
    # Only what no tolerance can move enters the hash: the kinds of the two cells, and their texts.
    return [F.xxhash64(kind(a), kind(b), F.coalesce(a["text"], F.lit("")), F.coalesce(b["text"], F.lit(""))).cast("decimal(38,0)"),
            product, moved]


def column_fingerprints(rows: DataFrame) -> DataFrame:
    """(qid, a, b, hash, total, slack, low, high, same, n) of every pair of places a <= b in the cells of each question's rows."""
    places = F.sequence(F.lit(0), F.size("cells") - 1)
    pairs = F.flatten(F.transform(places, lambda a: F.transform(F.sequence(a, F.size("cells") - 1), lambda b: F.struct(
        a.alias("a"), b.alias("b"), F.get("cells", a).alias("x"), F.get("cells", b).alias("y")))))
    exploded = rows.where(F.size("cells") > 0).select("qid", F.inline(pairs))
    hashed, product, moved = _joint(F.col("x"), F.col("y"))
    return exploded.groupBy("qid", "a", "b").agg(
        F.sum(hashed).alias("hash"), F.sum(product).alias("total"), F.sum(moved).alias("slack"),
        F.min("x.number").alias("low"), F.max("x.number").alias("high"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("same"),
        F.count("*").alias("n"))


def may_face(gold: dict, pred: dict) -> bool:
    """Whether two fingerprints allow a row-by-row match; never rules out a real one."""
    if gold["hash"] != pred["hash"] or abs(gold["total"] - pred["total"]) > gold["slack"] + pred["slack"]:
        return False
    for end in ("low", "high"):
        if (gold[end] is None) != (pred[end] is None):
            return False
        if gold[end] is not None:
            reach = 2 * (ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * max(abs(gold[end]), abs(pred[end])))
            if abs(gold[end] - pred[end]) > reach:
                return False
    return True


def consistent_choices(gold: dict[tuple[int, int], dict], pred: dict[tuple[int, int], dict]) -> Iterator[list[int]]:
    """Choices of pred's columns, one for each of gold's, whose columns and pairs of columns all may match.

    Both map a pair of places a <= b to its fingerprint.
    """
    wanted, offered = 1 + max(a for a, _ in gold), 1 + max(a for a, _ in pred)

    def turned(table: dict, a: int, b: int) -> dict:
        return table[min(a, b), max(a, b)]

    def ends_fit(a: int, b: int) -> bool:
        return may_face(gold[a, a], pred[b, b])

    def pair_fits(a: int, b: int, x: int, y: int) -> bool:
        left, right = turned(gold, a, b), turned(pred, x, y)
        # The hash of a pair knows its order, the product does not.
        same_order = (a < b) == (x < y)
        return (not same_order or left["hash"] == right["hash"]) and (
            abs(left["total"] - right["total"]) <= left["slack"] + right["slack"])

    twins = [[d for d in range(c) if pred[d, c]["same"] == pred[d, c]["n"]] for c in range(offered)]
    fits = [[c for c in range(offered) if ends_fit(a, c)] for a in range(wanted)]

    def extended(taken: list[int]) -> Iterator[list[int]]:
        if len(taken) == wanted:
            yield taken
            return
        at = len(taken)
        for c in fits[at]:
            if c in taken or any(d not in taken for d in twins[c]):
                continue
            if all(pair_fits(b, at, taken[b], c) for b in range(at)):
                yield from extended([*taken, c])

    return extended([])


def column_choices(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(qid, choice, picks): the choices to compare, numbered from 0 on, for questions with more columns predicted."""
    named = lambda frame, side: column_fingerprints(frame).withColumn("side", F.lit(side))
    prints = named(gold, "gold").unionByName(named(pred, "pred"))

    def search(table: pa.Table) -> pa.Table:
        sides: dict[str, dict] = {"gold": {}, "pred": {}}
        for row in table.to_pylist():
            sides[row["side"]][row["a"], row["b"]] = row
        found = list(consistent_choices(sides["gold"], sides["pred"])) if all(sides.values()) else []
        return pa.table({
            "qid": pa.array([table["qid"][0].as_py()] * len(found), pa.int64()),
            "choice": pa.array(range(len(found)), pa.int64()), "picks": pa.array(found, pa.list_(pa.int32()))})

    return prints.groupBy("qid").applyInArrow(search, "qid long, choice long, picks array<int>")


def aligned_picks(gold: Column, pred: Column) -> Column:
    """Place in ``pred`` of each of gold's columns, by name where the names settle it, else as they stand."""
    trimmed = lambda names: F.transform(names, lambda name: F.lower(F.trim(name)))
    wanted, present = trimmed(gold), trimmed(pred)
    settled = (
        (F.size(F.array_distinct(wanted)) == F.size(wanted)) & (F.size(F.array_distinct(present)) == F.size(present))
        & (F.size(F.array_except(wanted, present)) == 0))
    by_name = F.transform(wanted, lambda name: (F.array_position(present, name) - 1).cast("int"))
    return F.when(settled, by_name).otherwise(F.transform(gold, lambda _, at: at))


def compared(choices: DataFrame, gold: DataFrame, pred: DataFrame, keys: list[str], spec: list[Column], **how) -> DataFrame:
    """(qid, choice, position, gold, pred) of the first mismatch of each choice that has one."""
    side = lambda frame, cells, n: frame.join(choices, "qid").select(
        "qid", "choice", *keys, cells.alias("cells"), F.lit(n).alias("gold_n"), F.lit(1 - n).alias("pred_n"))
    picked = F.transform("picks", lambda at: F.get("cells", at))
    both = side(gold, F.col("cells"), 1).unionByName(side(pred, picked, 0))
    rounded = F.transform("cells", lambda cell: F.struct(F.round(cell["number"], ORDER_DECIMALS), cell["text"]))
    faced = facing(both, ["qid", "choice"], keys, ["cells"], [*spec, rounded.asc(), F.col("cells").asc()], **how)
    agree = F.forall(F.zip_with("gold.cells", "pred.cells", lambda a, b: F.struct(_cell_agrees(a, b).alias("ok"))), lambda x: x["ok"])
    return faced.where(~agree).groupBy("qid", "choice").agg(
        F.min("position").alias("position"), F.min_by(F.struct("gold", "pred"), "position").alias("rows")).select(
        "qid", "choice", "position", "rows.gold", "rows.pred")


def settled_choices(choices: DataFrame, gold: DataFrame, pred: DataFrame, keys: list[str], spec: list[Column], **how) -> DataFrame:
    """(qid, equal, position, gold, pred): whether some choice of a question matches, else the first mismatch of its first."""
    shared_folder(choices.sparkSession)
    open_, first, found = choices.checkpoint(), 0, []
    while not open_.isEmpty():
        wave = open_.where(F.col("choice") < first + WAVE)
        wrong = compared(wave, gold, pred, keys, spec, **how)
        judged = wave.select("qid", "choice").join(wrong, ["qid", "choice"], "left").groupBy("qid").agg(
            F.bool_or(F.col("position").isNull()).alias("equal"),
            F.min_by(F.struct("position", "gold", "pred"), "choice").alias("first")).checkpoint()
        found.append(judged)
        first += WAVE
        open_ = open_.where(F.col("choice") >= first).join(judged.where("equal").select("qid"), "qid", "left_anti").checkpoint()
    if not found:
        return choices.sparkSession.createDataFrame([], f"qid long, equal boolean, position long, gold array<{CELL}>, pred array<{CELL}>")
    every = found[0]
    for judged in found[1:]:
        every = every.unionByName(judged)
    return every.groupBy("qid").agg(F.bool_or("equal").alias("equal"), F.min_by("first", "first.position").alias("first")).select(
        "qid", "equal", "first.position", F.col("first.gold.cells").alias("gold"), F.col("first.pred.cells").alias("pred"))


def some_projection_matches(gold: DataFrame, pred: DataFrame, gold_order: Order | None, pred_order: Order | None) -> bool:
    """Whether some choice of the wider table's columns matches, in a number of jobs that does not depend on the columns."""
    gold_order, pred_order = gold_order or [], pred_order or gold_order or []
    keys = [f"k{at}" for at in range(len(gold_order))]

    def rows(df: DataFrame, order: Order) -> DataFrame:
        named = (F.col(f"`{name}`").alias(key) for key, (name, _) in zip(keys, order, strict=True))
        return df.select(F.lit(0).cast("long").alias("qid"), *named, cells_of(df).alias("cells"))

    golds, preds = rows(gold, gold_order), rows(pred, pred_order)
    spec = [F.col(key).asc() if rising else F.col(key).desc() for key, (_, rising) in zip(keys, gold_order, strict=True)]
    return not settled_choices(column_choices(golds, preds), golds, preds, keys, spec).where("equal").isEmpty()


def label_results(items: DataFrame, gold: DataFrame, pred: DataFrame, **how) -> DataFrame:
    """``qid, correct, attribution, rule, reason, gold_rows, pred_rows, first_mismatch`` of every question.

    ``items`` has ``qid, gold_columns, pred_columns, ordered, error``. A question with an error is an ``exec_error``; the
    others are ``correct`` or a ``wrong_result`` for the reason given. Equal row counts come first, two empty results agree
    whatever their columns are, columns are aligned by name, extra predicted columns are forgiven if a choice matches.
    """
    spark = items.sparkSession
    shared_folder(spark)
    counted = gold.select("qid", F.lit(1).alias("g")).unionByName(pred.select("qid", F.lit(0).alias("g"))).groupBy("qid").agg(
        F.sum("g").alias("gold_rows"), F.sum(1 - F.col("g")).alias("pred_rows"))
    extra = F.size("pred_columns") - F.size("gold_columns")
    rule = (
        F.when(F.col("error").isNotNull(), "exec_error").when(F.col("gold_rows") != F.col("pred_rows"), "row_count")
        .when(F.col("gold_rows") == 0, "both_empty").when(extra < 0, "column_count").when(extra > 0, "projection")
        .when(F.col("ordered"), "ordered").otherwise("multiset"))
    cases = items.join(counted, "qid", "left").fillna(0, ["gold_rows", "pred_rows"]).withColumn("rule", rule).checkpoint()

    compared_ = cases.where(F.col("rule").isin("ordered", "multiset", "projection")).select(
        "qid", "ordered", "rule", "gold_columns", "pred_columns")
    place = F.when(F.col("ordered"), F.col("at")).alias("place")
    # A task sorts and collapses all rows it gets, so their number decides how many tasks there are, not their compressed bytes.
    rows = cases.agg(F.sum(F.col("gold_rows") + F.col("pred_rows"))).first()[0] or 0
    dealt = (frame.repartition(rows // ROWS_PER_TASK + 1, "qid") for frame in (gold, pred))
    golds, preds = (frame.join(compared_, "qid").select("qid", "rule", place, "cells") for frame in dealt)
    wider = (frame.where(F.col("rule") == "projection").select("qid", "cells") for frame in (golds, preds))
    straight = compared_.where(F.col("rule") != "projection").select(
        "qid", F.lit(0).cast("long").alias("choice"), aligned_picks(F.col("gold_columns"), F.col("pred_columns")).alias("picks"))
    choices = straight.unionByName(column_choices(*wider))
    judged = settled_choices(
        choices, golds.drop("rule"), preds.drop("rule"), ["place"], [F.col("place").asc()], **how)

    correct = (F.col("rule") == "both_empty") | F.coalesce("equal", F.lit(False))
    said = (
        F.when(F.col("rule") == "exec_error", F.col("error"))
        .when(F.col("rule") == "row_count", F.concat_ws(" ", F.lit("rows: gold"), "gold_rows", F.lit("pred"), "pred_rows"))
        .when(F.col("rule").isin("column_count", "projection"), F.concat_ws(
            " ", F.lit("columns: gold"), F.size("gold_columns"), F.lit("pred"), F.size("pred_columns")))
        .otherwise(F.concat(F.lit("row "), F.col("position"), F.lit(" differs: gold "), F.to_json("gold"), F.lit(" pred "), F.to_json("pred"))))
    straight_rule = F.col("rule").isin("ordered", "multiset")
    labelled = cases.join(judged, "qid", "left").withColumns({"correct": correct, "said": said})
    return labelled.select(
        "qid", "correct",
        F.when(F.col("rule") == "exec_error", "exec_error").when(F.col("correct"), "correct").otherwise("wrong_result").alias("attribution"),
        F.when((F.col("rule") == "projection") & ~F.col("correct"), "column_count").otherwise(F.col("rule")).alias("rule"),
        F.when(F.col("correct"), "").otherwise(F.substring(F.col("said"), 1, REASON_LENGTH)).alias("reason"),
        "gold_rows", "pred_rows", F.when(straight_rule & ~F.col("correct"), F.col("position")).alias("first_mismatch"))
