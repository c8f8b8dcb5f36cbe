"""Exact quantiles of every group at once, for groups of any size.

Every wanted place narrows the range it lies in: each round cuts the open ranges of all groups into ``CELLS`` equal cells,
counts them, and goes on with the cell that holds the place, cut to the smallest and largest value in it, until a range is one
value. Cells are even in magnitude and in value by turns, so a dozen rounds settle any doubles. A round moves at most ``CELLS``
rows per range and task, and no group is sorted or held by a task.

With up to ``FEW`` groups their ranges go to the rows: the first rounds read the rows as they are, and once the open ranges hold
less than one in ``SHRUNK`` of them, the distinct values in these are counted and stored, and later rounds read them instead. So
no task holds the distinct values of its rows. With more groups the distinct values of all rows are counted and stored first, and
meet the ranges by group, a group with a third of all rows in ``SALTS`` parts.

NULL, NaN and the infinities have no place; a group with no other value gets no quantiles. NULL is a group too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.evaluation import stored

CELLS = 1024
SALTS = 16
FEW = 20_000
SHRUNK = 32


def _magnitude(value: Column) -> Column:
    """Rises with the value, evenly over its orders of magnitude."""
    return F.signum(value) * F.coalesce(F.log2(F.abs(value)) + 1080, F.lit(0.0))


def _cell(value: Column, low: Column, high: Column, even_magnitudes: bool) -> Column:
    """Number of the cell, rising with the value; the largest value has one of its own, so every round narrows."""
    at, first, last = map(_magnitude, (value, low, high)) if even_magnitudes else (value, low, high)
    share = F.try_divide(at / 2 - first / 2, last / 2 - first / 2)
    return F.when(value == high, CELLS).otherwise(F.coalesce(F.floor(share * CELLS), F.lit(0))).cast("int")


def _histogram(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy("of_group", "value").agg(F.count("*").alias("n")).withColumn(
        "salt", F.pmod(F.hash("value"), F.lit(SALTS))))


def _narrowed(values: DataFrame, places: DataFrame, few: bool, even_magnitudes: bool) -> DataFrame:
    """``places`` (of_group, at, place, low, high, inside) with the range of each cut to the cell it lies in; ``inside`` is the
    number of rows in the range."""
    ranges = places.select("of_group", "low", "high").distinct()
    if few:
        met = values.join(F.broadcast(ranges), "of_group")
    else:
        met = values.join(ranges.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["of_group", "salt"])
    met = met.where(F.col("value").between(F.col("low"), F.col("high")))
    cell = _cell(F.col("value"), F.col("low"), F.col("high"), even_magnitudes)
    cells = met.groupBy("of_group", "low", "high", cell.alias("cell")).agg(
        F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    so_far = Window.partitionBy("of_group", "low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    holds = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n"))
    return places.drop("inside").join(cells, ["of_group", "low", "high"]).where(holds).select(
        "of_group", "at", (F.col("place") - F.col("before")).alias("place"),
        F.col("least").alias("low"), F.col("most").alias("high"), F.col("n").alias("inside"))


def group_quantiles(df: DataFrame, value: str, group: str, shares: list[float]) -> DataFrame:
    """``of_group, n, q``: how many numbers a group has and its quantiles, interpolated between neighbours.

    ``of_group`` is a struct with the group's value, which joins NULL with NULL.
    """
    number = F.col(f"`{value}`").cast("double")
    rows = df.select(
        F.struct(F.col(f"`{group}`").alias("value")).alias("of_group"),
        F.when(number == 0, 0.0).otherwise(number).alias("value")).where(F.abs("value") < float("inf"))
    spans = stored(rows.groupBy("of_group").agg(
        F.count("*").alias("rows"), F.min("value").alias("low"), F.max("value").alias("high")))
    groups, total = spans.agg(F.count("*"), F.sum("rows")).first()
    few = groups <= FEW
    wanted = [(F.col("rows") - 1) * F.lit(float(share)) for share in shares]
    both = F.array_distinct(F.array(*(end.cast("long") for at in wanted for end in (F.floor(at), F.ceil(at)))))
    places = stored(spans.select("of_group", F.explode(both).alias("at"), "low", "high", F.col("rows").alias("inside")).withColumn(
        "place", F.col("at")))
    values, counted = (rows.withColumn("n", F.lit(1).cast("long")), False) if few else (_histogram(rows), True)
    settled = []
    while True:
        settled.append(places.where("low = high").select("of_group", "at", F.col("low").alias("value")))
        open_ = places.where("low < high")
        left = open_.select("of_group", "low", "high", "inside").distinct().agg(F.sum("inside")).first()[0]
        if not left:
            break
        if not counted and left * SHRUNK < total:
            ranges = F.broadcast(open_.select(F.col("of_group").alias("of"), "low", "high").distinct())
            inside = (F.col("of_group") == F.col("of")) & F.col("value").between(F.col("low"), F.col("high"))
            values, counted = _histogram(rows.join(ranges, inside, "left_semi")), True
        places = stored(_narrowed(values, open_, few, even_magnitudes=len(settled) % 2 == 1))
    found = reduce(DataFrame.unionByName, settled).groupBy("of_group").agg(
        F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("at"))

    def interpolated(at: Column) -> Column:
        low, high = F.col("at")[F.floor(at).cast("long")], F.col("at")[F.ceil(at).cast("long")]
        return low + (high - low) * (at - F.floor(at))

    return spans.join(found, "of_group").select("of_group", F.col("rows").alias("n"), F.array(*map(interpolated, wanted)).alias("q"))


def fences(df: DataFrame, value: str, group: str, k: float) -> DataFrame:
    """``of_group, n, q1, q3, low_fence, high_fence``: ``k`` interquartile ranges beyond the quartiles.

    Counted, and marked to go to the rows it is joined to if there are no more than ``FEW`` groups: by the group, the rows of a
    large one would meet in one task.
    """
    quartiles = group_quantiles(df, value, group, [0.25, 0.75]).select(
        "of_group", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    reach = F.lit(float(k)) * (F.col("q3") - F.col("q1"))
    limits = stored(quartiles.withColumns({"low_fence": F.col("q1") - reach, "high_fence": F.col("q3") + reach}))
    return F.broadcast(limits) if limits.count() <= FEW else limits
