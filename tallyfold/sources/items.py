"""Evaluation files: question sets as JSON lines, per-question reports as CSV, run summaries as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM_SCHEMA = "id bigint, question string, gold_sql string, difficulty string, tags array<string>"
RUN_FIELDS = "tag string, timestamp string, model string, dataset string, wall_time_s double"
SUMMARY_SCHEMA = (
    f"run string, {RUN_FIELDS}, total bigint, correct bigint, exec_accuracy double, first_round_pass double, "
    "saved_by_correction double, saved_count bigint, first_round_fail_count bigint, avg_latency_s double, "
    "p50_latency_s double, p95_latency_s double, avg_total_tokens bigint, avg_llm_calls double, "
    "by_difficulty map<string, struct<total: int, accuracy: double>>, attribution map<string, int>"
)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items. Blank lines hold no record; a malformed line stops the job instead of vanishing."""
    return spark.read.schema(ITEM_SCHEMA).option("mode", "FAILFAST").json(path)


def write_jsonl(items: DataFrame, path: str) -> str:
    """One item per line, UTF-8. Every task writes its own part file."""
    items.write.json(path)
    return path


# What a line of a report must not contain, and how it is written instead; the backslash comes first.
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"))


def one_line(text: Column) -> Column:
    """The text with line breaks and backslashes written as escapes, so that a record is one line."""
    for character, written in ESCAPES:
        text = F.replace(text, F.lit(character), F.lit(written))
    return text


def as_written(text: Column) -> Column:
    """What ``one_line`` was given: whole escapes are looked for from the left, each backslash belonging to one."""

    def breaks(half: Column) -> Column:
        for character, written in ESCAPES[1:]:
            half = F.replace(half, F.lit(written), F.lit(character))
        return half

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), breaks), "\\")


def write_report_csv(results: DataFrame, path: str) -> str:
    """Per-question details with a header, one line per record; arrays, maps and structs are written as JSON text."""

    def written(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            column = F.to_json(column)
        elif not isinstance(field.dataType, T.StringType):
            return column
        return one_line(column).alias(field.name)

    results.select(*map(written, results.schema.fields)).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return path


def read_report_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines are records, so a large file is read by several tasks."""
    stored = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return stored.withColumns({
        field.name: as_written(F.col(f"`{field.name}`"))
        for field in stored.schema.fields if isinstance(field.dataType, T.StringType)})


def write_summary_json(summary: DataFrame, path: str) -> str:
    """Run summaries, one JSON object per run, with the nested maps kept."""
    summary.write.json(path)
    return path


def read_summary_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).option("mode", "FAILFAST").json(path)
