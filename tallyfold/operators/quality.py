"""Data-quality operators over any DataFrame. They report and flag; they never drop a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.functions.dates import OFFSET_SUFFIX, parse_stamp, stamp_shape
from tallyfold.operators.quantiles import fences

EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def parse_stamps(df: DataFrame, *columns: str) -> DataFrame:
    """Add a typed ``<column>_ts`` beside each text timestamp."""
    return df.withColumns({f"{name}_ts": parse_stamp(F.col(name)) for name in columns})


def stamp_census(df: DataFrame, column: str) -> DataFrame:
    """Rows per timestamp shape: ``shape, n``."""
    return df.groupBy(stamp_shape(F.col(column)).alias("shape")).agg(F.count("*").alias("n"))


def offset_suffixes(df: DataFrame, column: str) -> DataFrame:
    """Rows whose timestamp carries the meaningless offset."""
    return df.agg(F.count_if(F.col(column).endswith(OFFSET_SUFFIX)).alias("n"))


def normalize_case(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.lower(column))


def string_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if isinstance(field.dataType, T.StringType)]


def case_variants(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values of each string column, as written and in lower case.

    All columns are laid under each other and counted in one pass. Values collapse on the map side
    before they are shuffled, and again once lower-cased, so no column and no value needs one task.
    """
    names = columns or string_columns(df)
    named = df.select(*(F.col(f"`{name}`") for name in names))
    cells = named.unpivot([], [F.col(f"`{name}`") for name in names], "column", "value").where(F.col("value").isNotNull())
    distinct = cells.distinct()
    spellings = distinct.groupBy("column", F.lower("value").alias("lowered")).agg(F.count("*").alias("spellings"))
    return spellings.groupBy("column").agg(F.sum("spellings").alias("n_distinct"), F.count("*").alias("n_lower"))


def null_columns(df: DataFrame) -> DataFrame:
    """Columns that hold nothing but NULL in a table that has rows: ``column, n_rows``."""
    filled = df.agg(F.count("*").alias("n_rows"), *(F.count(F.col(f"`{name}`")).alias(name) for name in df.columns))
    counts = filled.unpivot(["n_rows"], df.columns, "column", "filled")
    return counts.where((F.col("filled") == 0) & (F.col("n_rows") > 0)).select("column", "n_rows")


def empty_issue(df: DataFrame) -> DataFrame:
    """One row if the table is empty, else none. Stops at the first row it finds."""
    found = df.limit(1).agg(F.count("*").alias("n"))
    return found.where(F.col("n") == 0).select(
        F.lit("empty").alias("rule"), F.lit(None).cast("string").alias("column"), F.lit("no rows").alias("detail")
    )


def issue_report(df: DataFrame) -> DataFrame:
    """Empty result, all-NULL columns and case variants in one table: ``rule, column, detail``.

    The other rules cannot fire on an empty table, so an empty one yields exactly one issue.
    """
    missing = null_columns(df).select(F.lit("all_null").alias("rule"), "column", F.lit("only NULL").alias("detail"))
    report = empty_issue(df).unionByName(missing)
    names = string_columns(df)
    if not names:
        return report
    variants = case_variants(df, names).where(F.col("n_lower") < F.col("n_distinct"))
    detail = F.format_string("%d values, %d without case", "n_distinct", "n_lower")
    return report.unionByName(
        variants.select(F.lit("case_variants").alias("rule"), "column", detail.alias("detail"))
    )


def flagged(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition; NULL counts as not met."""
    return df.where(F.coalesce(condition, F.lit(False)))


def null_values(df: DataFrame, column: str) -> DataFrame:
    return flagged(df, F.col(column).isNull())


def negative_values(df: DataFrame, column: str) -> DataFrame:
    return flagged(df, F.col(column) < 0)


def out_of_range(df: DataFrame, column: str, low, high) -> DataFrame:
    return flagged(df, ~F.col(column).between(low, high))


def too_precise(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """Money with more decimals than the currency has."""
    amount = F.col(column).cast("decimal(38,6)")
    return flagged(df, F.round(amount, digits) != amount)


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Foreign-key values without a parent and how many rows hold each. NULL refers to nothing.

    Child rows are counted per key first: a hot key crosses the shuffle once per task.
    """
    referred = child.where(F.col(foreign_key).isNotNull()).groupBy(foreign_key).agg(F.count("*").alias("n"))
    return referred.join(parent.select(F.col(key).alias(foreign_key)), foreign_key, "left_anti")


def duplicates(df: DataFrame, key: str, content: list[str] | None = None) -> DataFrame:
    """Groups of rows with equal content under different keys: the kept (smallest) key and the number.

    NULLs compare as equal. However many copies a group has, each task sends one row for it.
    """
    columns = content or [name for name in df.columns if name != key]
    groups = df.groupBy(*columns).agg(F.min(key).alias("kept"), F.count("*").alias("copies"))
    return groups.where(F.col("copies") > 1)


def bad_emails(df: DataFrame, key: str, column: str) -> DataFrame:
    """Addresses that are malformed or belong to several rows, one row per address."""
    per_address = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.min(key).alias("first_id"), F.count("*").alias("n")
    )
    marked = per_address.withColumns({"malformed": ~F.col(column).rlike(EMAIL_SHAPE), "reused": F.col("n") > 1})
    return marked.where("malformed OR reused")


def outliers(df: DataFrame, value: str, group: str, k: float = 3.0) -> DataFrame:
    """Rows beyond the quartiles of their group by more than ``k`` interquartile ranges, on either side.

    The quartiles are exact (``quantiles``); the fences, one row per group, go back to the rows by the group, NULL
    being a group too. Infinite values lie beyond any fence; NULL and NaN are never reported.
    """
    limits = fences(df, value, group, k).select("of_group", "low_fence", "high_fence")
    joined = df.join(limits, F.struct(df[group].alias("value")) == limits["of_group"])
    number = df[value].cast("double")
    beyond = ((number < F.col("low_fence")) | (number > F.col("high_fence"))) & ~F.isnan(number)
    return joined.where(beyond).drop("of_group", "low_fence", "high_fence")
