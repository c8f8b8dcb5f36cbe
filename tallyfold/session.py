"""Session helpers: local defaults for tests and the folder for materialised intermediates."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", app: str = "tallyfold", **conf: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the submitted session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def cluster_settings(input_bytes: int) -> dict[str, str]:
    """SQL settings for a submitted session that reads about ``input_bytes`` in its largest query.

    Shuffles start with partitions of about 128 MB and are coalesced at run time where a filter left
    less; a partition far above the others is split. Broadcasts stay tied to measured sizes.
    """
    partitions = min(max(input_bytes // (128 * 1024**2), 200), 100_000)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256MB",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": "256MB",
        "spark.sql.autoBroadcastJoinThreshold": "64MB",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    }


@cache
def _own_folder() -> tempfile.TemporaryDirectory:
    """Removed with all it holds when the process ends."""
    return tempfile.TemporaryDirectory(prefix="tallyfold-", ignore_cleanup_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder for checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that has none gets a
    folder of its own, because executors elsewhere could not read it.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        folder = _own_folder().name
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path inside the shared folder, never used before."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
