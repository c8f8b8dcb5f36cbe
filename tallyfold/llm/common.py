"""What several operators need: checkpoints in the shared folder, cleaned inputs, connected components."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.session import fresh_path, shared_folder


#: Spark's setting under which the shuffle files of an action are deleted when it ends.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """For frames made in here."""
    before = spark.conf.get(SHUFFLES_END, "false")
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_END, before)


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, computed once and read from the shared checkpoint folder, so lost executors cost no rerun.

    The shuffle files behind it go as soon as it is written. Nothing reads them again, but Spark would keep them for as long
    as the driver's memory holds the plan, often beside all files of the next step. Spark takes the setting when a frame is
    made, hence the selection.
    """
    spark = frame.sparkSession
    shared_folder(spark)
    with _shuffles_end(spark):
        return frame.select("*").checkpoint()


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame, computed once and read from Parquet files in the shared folder. For very many short rows, and for texts: a
    checkpoint keeps each as it lies in memory, several times its bytes here. Shuffle files go as those of a checkpoint."""
    path = fresh_path(frame.sparkSession, label)
    with _shuffles_end(frame.sparkSession):
        frame.select("*").write.parquet(path, compression="zstd")
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Deletes the files of ``stored`` frames, which nothing reads any more; Spark's cleaner only knows checkpoints."""
    spark = frame.sparkSession
    for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, n_bytes: int = 0) -> None:
    """Deletes the shuffle files of finished steps now, instead of whenever the driver's memory happens to be collected.

    Spark deletes them once nothing refers to the plan: first Python's frames go, then the plans that they held.
    Executors delete beside their tasks. Behind ``n_bytes`` of input they get a moment, 5 seconds at most, so that the
    next step's files do not come to lie beside those that are still to go.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
    time.sleep(min(5.0, n_bytes / 1e8))


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """What a worker keeps from task to task under a key; one thing at a time, so operators that run one after another
    in the same workers do not add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """For tasks that hold much themselves: nothing of an earlier operator stays."""
    _HELD.clear()


def short_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Fewer rows per Arrow batch than the default: rows here are whole texts, and every copy of a batch counts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(name: str, frame: DataFrame) -> str:
    """The name, with as many underscores in front as keep it apart from the frame's columns."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_text(column: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


#: Rows of a few numbers that are worth a task of their own, and the least number of tasks.
ROWS_PER_TASK = 20_000
LEAST_TASKS = 8


def tasks_for(rows: int) -> int:
    """So many tasks as ``rows`` short rows ask for; it grows with them without a bound."""
    return max(LEAST_TASKS, ceil(rows / ROWS_PER_TASK))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return met.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    lower = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.union(least).coalesce(tasks).distinct().coalesce(tasks)


def _state(edges: DataFrame, tasks: int) -> tuple[int, bool]:
    """The number of edges, and whether they are stars: each node has one edge down, to a node that has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).coalesce(tasks)
    n, worst = nodes.agg(F.sum("down"), F.max(F.when(F.col("down") > 0, F.col("down") + F.col("up")))).first()
    return n or 0, (worst or 0) <= 1


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    ``edges`` has two columns of comparable ids; direction, loops and repeats do not matter. Alternates the
    large-star and small-star steps until all edges are stars: a logarithmic number of rounds, each a grouping and a
    join over edges only. A node with very many edges is a skewed join key that run-time splitting takes apart; no
    neighbour list is ever collected. The number of edges decides into how many tasks they go: there are many short
    rounds, and with few edges in many shuffle partitions the driver would keep the figures of very many empty tasks.
    """
    x, y = edges.columns
    edges = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a > b").distinct()
    edges = checkpointed(edges)
    tasks = tasks_for(edges.count())
    while True:
        edges = edges.coalesce(tasks)
        n, done = _state(edges, tasks)
        if done:
            break
        tasks = tasks_for(n)
        edges = checkpointed(_small_star(_large_star(edges, tasks), tasks))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct())
