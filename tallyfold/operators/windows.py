"""Ranking, growth and consecutive-day operators.

Window partitions are only built over data that an aggregate has already bounded: months, the days of
one user, or the n best values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked_top(df: DataFrame, value: str, n: int, rank: str = "rk") -> DataFrame:
    """Rows whose RANK by a value, highest first, is at most n; ties keep their shared rank.

    A plain RANK would pull every tied row into one task. Here only the histogram of values is ranked:
    at most n distinct values can have a rank up to n, so n histogram rows decide, and the ranks go
    back to the rows by an equality join.
    """
    best = df.groupBy(value).agg(F.count("*").alias("holders")).orderBy(F.desc(value)).limit(n)
    above = W.orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, -1)
    ranks = best.select(value, (F.coalesce(F.sum("holders").over(above), F.lit(0)) + 1).alias(rank))
    return df.join(ranks.where(F.col(rank) <= n), value)


def best_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First n rows per group in a total order. Spark limits each group before the shuffle."""
    numbered = df.withColumn("rn", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return numbered.where(F.col("rn") <= n).drop("rn")


def period_growth(per_period: DataFrame, period: str, value: str, name: str = "growth") -> DataFrame:
    """Relative change to the previous period present; NULL for the first.

    Takes one row per period, so the single ordering partition holds as many rows as there are months.
    """
    before = F.lag(value).over(W.orderBy(period))
    change = F.try_divide(F.col(value).cast("double"), before.cast("double")) - 1
    return per_period.withColumn(name, F.round(change, 6))


def day_runs(df: DataFrame, key: str, day: str, shortest: int) -> DataFrame:
    """Runs of at least ``shortest`` consecutive days per key: ``key, first_day, length``.

    After the distinct a key holds one row per calendar day, which bounds its window partition
    however many events it had.
    """
    days = df.select(F.col(key), F.col(day).cast("date").alias("day")).distinct()
    place = F.row_number().over(W.partitionBy(key).orderBy("day"))
    marked = days.withColumn("island", F.date_sub(F.col("day"), place))
    runs = marked.groupBy(key, "island").agg(F.min("day").alias("first_day"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= shortest).drop("island")
