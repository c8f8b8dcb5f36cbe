"""Capped results, and running one admitted statement."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyfold.operators.logs import admission, bare_statement

# The limits of an interactive answer.
MAX_ROWS = 200


def capped(df: DataFrame, order: list[Column], max_rows: int = MAX_ROWS) -> DataFrame:
    """First rows in a total order, each with a flag telling that more existed.

    One row beyond the cap is fetched to know; at most ``max_rows + 1`` rows ever reach one task.
    """
    beyond = df.orderBy(*order).limit(max_rows + 1)
    numbered = beyond.withColumns({
        "place": F.row_number().over(W.orderBy(*order)),
        "truncated": F.count("*").over(W.partitionBy()) > max_rows,
    })
    return numbered.where(F.col("place") <= max_rows).drop("place")


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancel the jobs this thread starts once the time is up, and keep cancelling until it leaves."""
    context, tag = spark.sparkContext, f"limited-{uuid.uuid4().hex}"
    done, expired = threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not done.wait(wait):
            expired.set()
            context.cancelJobsWithTag(tag)
            wait = 0.5

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as error:
        if expired.is_set():
            raise TimeoutError(f"cancelled after {seconds} s") from error
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)


def run_statement(
    spark: SparkSession, sql: str, max_rows: int = MAX_ROWS, seconds: float | None = None
) -> tuple[list[Row], bool]:
    """Run one read-only statement over the registered views, capped like an interactive answer.

    Returns the capped rows and whether more existed. No more than ``max_rows + 1`` rows are fetched,
    and jobs are cancelled when the time is up, if ``seconds`` are given.
    """
    checked = spark.range(1).select(
        admission(F.lit(sql)).alias("reason"), bare_statement(F.lit(sql)).alias("text")
    ).first()
    if checked["reason"] != "ok":
        raise ValueError(f"statement refused: {checked['reason']}")
    with time_limit(spark, seconds) if seconds else nullcontext():
        rows = spark.sql(checked["text"]).limit(max_rows + 1).collect()
    return rows[:max_rows], len(rows) > max_rows
