"""Tolerant comparison of two result tables of any size.

Two tables agree if, row by row, texts are equal and numbers differ by no more than a small absolute
or relative tolerance. Which rows face each other is decided by position: the caller's order if the
result has one, else the order of the rounded cells. A tolerance is not an equality key, so positions
are what the join runs on. They are built without a global window:

1. equal rows of both sides collapse into one row with two counts (a row repeated a billion times
   becomes one row);
2. the distinct rows are range-partitioned and stored once, so a lost executor cannot move a boundary;
3. running counts per partition plus the totals of the partitions before it give each distinct row the
   interval of positions it fills on either side;
4. intervals are cut at fixed blocks of positions and merged block by block.

Rows whose numbers round to the same four decimals are interchangeable for the order; numbers just
across a rounding edge may face another partner than in a different sort. Missing values sort first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.text import strip
from tallyfold.session import shared_folder

# Tolerances, and decimals used for ordering.
ABSOLUTE_TOLERANCE = 0.011
RELATIVE_TOLERANCE = 1e-6
ORDER_DECIMALS = 4

POSITIONS_PER_BLOCK = 1_000_000

Order = list[tuple[str, bool]]


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def normal_cell(field: T.StructField) -> Column:
    """A number as double, anything else as trimmed text, NULL kept."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.BooleanType):
        column = column.cast("int")
    return column.cast("double") if is_number(field.dataType) else strip(column.cast("string"))


def normalized(df: DataFrame) -> DataFrame:
    return df.select(*(normal_cell(field).alias(field.name) for field in df.schema.fields))


def tolerance(number: Column) -> Column:
    return F.greatest(F.lit(ABSOLUTE_TOLERANCE), F.abs(number) * RELATIVE_TOLERANCE)


def cells_agree(gold: Column, pred: Column, gold_number: bool, pred_number: bool) -> Column:
    """Both missing, or equal texts, or numbers within the tolerance of the predicted one."""
    both_missing = gold.isNull() & pred.isNull()
    if gold_number != pred_number:
        return both_missing
    if not gold_number:
        return gold.eqNullSafe(pred)
    return both_missing | F.coalesce(F.abs(gold - pred) <= tolerance(pred), F.lit(False))


def aligned_columns(gold: list[str], pred: list[str]) -> list[str]:
    """``pred``'s columns in gold's order by name, or as they are if the names do not settle it."""
    wanted = [name.strip().lower() for name in gold]
    present = {name.strip().lower(): name for name in pred}
    unambiguous = len(set(wanted)) == len(wanted) and len(present) == len(pred)
    if not unambiguous or not set(wanted) <= set(present):
        return pred
    return [present[name] for name in wanted]


def aligned(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return pred.select(*(F.col(f"`{name}`") for name in aligned_columns(gold.columns, pred.columns)))


def row_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Both row counts and whether they are equal."""
    sides = gold.select(F.lit(1).alias("gold")).unionByName(pred.select(F.lit(0).alias("gold")))
    counted = sides.agg(F.count_if(F.col("gold") == 1).alias("gold_rows"), F.count_if(F.col("gold") == 0).alias("pred_rows"))
    return counted.withColumn("equal", F.col("gold_rows") == F.col("pred_rows"))


def _sides(
    gold: DataFrame, pred: DataFrame, gold_columns: list[str], pred_columns: list[str],
    gold_order: Order, pred_order: Order,
) -> tuple[DataFrame, list[bool]]:
    """Both tables under each other as order keys ``k0..`` and cells ``c0..``, with a counter per side.

    Where one side has numbers and the other text, both become marked text that only agrees on NULL.
    """
    gold_fields = [gold.schema[name] for name in gold_columns]
    pred_fields = [pred.schema[name] for name in pred_columns]
    pairs = list(zip(gold_fields, pred_fields, strict=True))
    numbers = [is_number(g.dataType) and is_number(p.dataType) for g, p in pairs]
    mixed = [is_number(g.dataType) != is_number(p.dataType) for g, p in pairs]

    def one(df: DataFrame, fields: list[T.StructField], order: Order, is_gold: bool) -> DataFrame:
        cells = [normal_cell(field) for field in fields]
        marked = [F.concat(F.lit("gold " if is_gold else "pred "), cell.cast("string")) if odd else cell
                  for cell, odd in zip(cells, mixed, strict=True)]
        return df.select(
            *(F.col(f"`{name}`").alias(f"k{at}") for at, (name, _) in enumerate(order)),
            *(cell.alias(f"c{at}") for at, cell in enumerate(marked)),
            F.lit(int(is_gold)).alias("gold_n"), F.lit(int(not is_gold)).alias("pred_n"),
        )

    left, right = one(gold, gold_fields, gold_order, True), one(pred, pred_fields, pred_order, False)
    return left.unionByName(right), numbers


def facing(
    both: DataFrame, groups: list[str], keys: list[str], cells: list[str], spec: list[Column],
    positions_per_block: int = POSITIONS_PER_BLOCK,
) -> DataFrame:
    """Which rows face each other: ``<groups>, position, gold, pred`` at every place where either row changes.

    ``both`` holds both sides of one or of many pairs of tables: the pair (``groups``), order keys, cells, and the
    counters ``gold_n`` and ``pred_n``; ``spec`` orders the rows of a pair. Both sides of a pair must have equally many rows.
    """
    collapsed = both.groupBy(*groups, *keys, *cells).agg(F.sum("gold_n").alias("gold_n"), F.sum("pred_n").alias("pred_n"))
    shared_folder(both.sparkSession)
    ranged = collapsed.repartitionByRange(*(F.col(name).asc() for name in groups), *spec)
    stored = ranged.withColumn("part", F.spark_partition_id()).checkpoint()

    per_part = stored.groupBy("part", *groups).agg(F.sum("gold_n").alias("gold_all"), F.sum("pred_n").alias("pred_all"))
    earlier = W.partitionBy(*groups).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_part.select(
        "part", *groups,
        *(F.coalesce(F.sum(f"{side}_all").over(earlier), F.lit(0)).alias(f"{side}_off") for side in ("gold", "pred")))
    within = W.partitionBy("part", *groups).orderBy(*spec).rowsBetween(W.unboundedPreceding, -1)
    counted = stored.withColumns(
        {f"{side}_in": F.coalesce(F.sum(f"{side}_n").over(within), F.lit(0)) for side in ("gold", "pred")}
    ).join(offsets, ["part", *groups])

    intervals = counted.select(*groups, F.struct(*cells).alias("row"), F.inline(F.array(*(
        F.struct(F.lit(side == "gold").alias("is_gold"), (F.col(f"{side}_off") + F.col(f"{side}_in")).alias("start"),
                 F.col(f"{side}_n").alias("n"))
        for side in ("gold", "pred")
    )))).where(F.col("n") > 0)
    width = F.lit(positions_per_block)
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n") - 1) / width)
    cut = intervals.withColumn("block", F.explode(F.sequence(first, last))).select(
        *groups, "block", F.greatest(F.col("start"), F.col("block") * width).alias("position"),
        F.when(F.col("is_gold"), F.col("row")).alias("gold"), F.when(~F.col("is_gold"), F.col("row")).alias("pred"),
    )
    so_far = W.partitionBy(*groups, "block").orderBy("position")
    return cut.select(
        *groups, "position", *(F.last(side, ignorenulls=True).over(so_far).alias(side) for side in ("gold", "pred")))


def mismatches(
    gold: DataFrame, pred: DataFrame, gold_columns: list[str] | None = None, pred_columns: list[str] | None = None,
    gold_order: Order | None = None, pred_order: Order | None = None, positions_per_block: int = POSITIONS_PER_BLOCK,
) -> DataFrame:
    """Where facing rows disagree: ``position, gold, pred`` at the first position of each stretch, at times twice.

    Both tables must have equally many rows. The two column lists name the columns that face each
    other, all by default; order columns need not be among them. Without an order the rounded cells
    give it. ``gold`` and ``pred`` are the facing rows, as structs of their cells under the names of gold's columns.
    """
    gold_order, pred_order = gold_order or [], pred_order or gold_order or []
    gold_columns = gold_columns or gold.columns
    both, numbers = _sides(gold, pred, gold_columns, pred_columns or pred.columns, gold_order, pred_order)
    cells = [f"c{at}" for at in range(len(numbers))]
    keys = [f"k{at}" for at in range(len(gold_order))]
    spec = [F.col(key).asc() if rising else F.col(key).desc() for key, (_, rising) in zip(keys, gold_order, strict=True)]
    spec += [F.round(cell, ORDER_DECIMALS).asc() if number else F.col(cell).asc()
             for cell, number in zip(cells, numbers, strict=True)]
    spec += [F.col(cell).asc() for cell, number in zip(cells, numbers, strict=True) if number]
    agree = F.lit(True)
    for cell, number in zip(cells, numbers, strict=True):
        agree = agree & cells_agree(F.col(f"gold.{cell}"), F.col(f"pred.{cell}"), number, number)
    found = facing(both, [], keys, cells, spec, positions_per_block).where(~agree)
    return found.select("position", *(
        F.struct(*(F.col(f"{side}.{cell}").alias(name) for cell, name in zip(cells, gold_columns, strict=True))).alias(side)
        for side in ("gold", "pred")))


def first_mismatch(gold: DataFrame, pred: DataFrame, gold_order: Order | None = None, pred_order: Order | None = None) -> DataFrame:
    """One row ``equal, gold_rows, pred_rows, first_mismatch, gold_row, pred_row``: the first facing rows that disagree, as
    JSON of their cells with missing ones kept. Columns are aligned by name and must be equally many; where the row
    counts differ no rows face each other."""
    counts = row_counts(gold, pred)
    sizes = counts.first()
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (
        ("first_mismatch", "bigint"), ("gold_row", "string"), ("pred_row", "string"))]
    if not sizes["equal"] or not sizes["gold_rows"]:
        return counts.select("equal", "gold_rows", "pred_rows", *nothing)
    how = {"pred_columns": aligned_columns(gold.columns, pred.columns), "gold_order": gold_order, "pred_order": pred_order}
    text = lambda side: F.to_json(F.col(side), {"ignoreNullFields": "false"})
    found = mismatches(gold, pred, **how).agg(
        F.min("position").alias("first_mismatch"),
        F.min_by(F.struct(text("gold").alias("gold"), text("pred").alias("pred")), "position").alias("rows"))
    return found.select(
        F.col("first_mismatch").isNull().alias("equal"), F.lit(sizes["gold_rows"]).alias("gold_rows"),
        F.lit(sizes["pred_rows"]).alias("pred_rows"), "first_mismatch", F.col("rows.gold").alias("gold_row"),
        F.col("rows.pred").alias("pred_row"))


def compare_rows(gold: DataFrame, pred: DataFrame, rule: str, **how) -> DataFrame:
    """Verdict on two tables with equally many rows."""
    found = mismatches(gold, pred, **how).agg(F.min("position").alias("first_mismatch"))
    return found.select(F.col("first_mismatch").isNull().alias("equal"), F.lit(rule).alias("rule"), "first_mismatch")


def _verdict(df: DataFrame, equal: bool, rule: str) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.lit(equal).alias("equal"), F.lit(rule).alias("rule"), F.lit(None).cast("bigint").alias("first_mismatch")
    )


def compare_tables(
    gold: DataFrame, pred: DataFrame, gold_order: Order | None = None, pred_order: Order | None = None
) -> DataFrame:
    """One row ``equal, rule, first_mismatch`` telling whether ``pred`` answers what ``gold`` does.

    Equal row counts come first, and two empty tables agree whatever their columns are. Columns are
    aligned by name; extra predicted columns are forgiven when some choice of columns matches.
    """
    counts = row_counts(gold, pred).first()
    if not counts["equal"]:
        return _verdict(gold, False, "row_count")
    if counts["gold_rows"] == 0:
        return _verdict(gold, True, "both_empty")
    how = {"gold_order": gold_order, "pred_order": pred_order}
    rule = "ordered" if gold_order else "multiset"
    extra = len(pred.columns) - len(gold.columns)
    if extra == 0:
        return compare_rows(gold, pred, rule, pred_columns=aligned_columns(gold.columns, pred.columns), **how)
    if extra > 0:
        from tallyfold.operators.bulk_compare import some_projection_matches

        if some_projection_matches(gold, pred, gold_order, pred_order):
            return _verdict(gold, True, "projection")
    return _verdict(gold, False, "column_count")
