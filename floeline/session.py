"""Session settings the library is written for."""

import os
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # splits an oversized partition in front of a table write
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.minBatchesToRetain": "10",
    "spark.ui.enabled": "false",
}


def reachable() -> None:
    """Lets Python workers find the package where the driver found it; a cluster gets it by --py-files or an install."""
    own, known = str(Path(__file__).resolve().parents[1]), SparkSession.active().sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if own not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, own])


def session(app: str = "floeline", master: str | None = None, **extra: str) -> SparkSession:
    """Build or reuse a session; `extra` keys use `__` in place of dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_width(input_bytes: int, target: int = 128 * 1024**2, least: int = 200) -> int:
    """Starting number of shuffle partitions for an input; adaptive execution merges small ones."""
    return max(least, -(-input_bytes // target))


def cluster_session(app: str = "floeline", input_bytes: int = 0, **extra: str) -> SparkSession:
    """Session for a cluster; the master comes from the submit command."""
    width = {"spark__sql__shuffle__partitions": str(shuffle_width(input_bytes))} if input_bytes else {}
    return session(app, None, **{**width, **extra})


def streaming_session(app: str = "floeline-stream", state_partitions: int | None = None, **extra: str) -> SparkSession:
    """Session for the streams.

    The partitions of a stream's state stay what they are when its checkpoint is made: the session's
    shuffle width, or `state_partitions` where the keyed state is small (two are enough for a few cameras).
    """
    width = {"spark__sql__shuffle__partitions": str(state_partitions)} if state_partitions else {}
    return session(app, None, **{**width, **extra})


def local_session(app: str = "floeline", cpus: int | None = None, **extra: str) -> SparkSession:
    """One-machine session for tests and the bench."""
    cpus = cpus or os.cpu_count() or 1
    settings = {"spark__sql__shuffle__partitions": str(cpus), "spark__driver__memory": "8g", **extra}
    built = session(app, f"local[{cpus}]", **settings)
    built.sparkContext.setLogLevel("ERROR")
    return built
