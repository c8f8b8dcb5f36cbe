"""What tables there are: inventory, choice of tables, time range, row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schema_inventory(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns of each table: ``table, ordinal, column, type``. Reads schemas only, no data."""
    columns = [
        F.struct(F.lit(name).alias("table"), F.lit(ordinal).alias("ordinal"), F.lit(field.name).alias("column"),
                 F.lit(field.dataType.simpleString()).alias("type"))
        for name, df in tables.items()
        for ordinal, field in enumerate(df.schema.fields, 1)
    ]
    return spark.range(1).select(F.inline(F.array(*columns)))


def schema_subset(inventory: DataFrame, names: list[str]) -> DataFrame:
    """The chosen tables of an inventory. No known name, or every name, means all tables."""
    listed = {row["table"] for row in inventory.select("table").distinct().collect()}
    known = [name for name in names if name in listed]
    if not known or len(known) >= len(listed):
        return inventory
    return inventory.where(F.col("table").isin(*known))


def data_range(df: DataFrame, moment: str) -> DataFrame:
    """First and last day of a typed column, cast after the aggregate so the scan reads it as it is."""
    return df.agg(
        F.min(moment).cast("date").cast("string").alias("first_day"),
        F.max(moment).cast("date").cast("string").alias("last_day"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, in one job."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)

