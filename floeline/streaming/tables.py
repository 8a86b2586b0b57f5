"""Streams that keep tables up to date."""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from floeline import schemas
from floeline.operators import messages, reports
from floeline.sources import manifest
from floeline.sources.tables import run_name
from floeline.streaming import keyed

#: Batches after which the folders of a day are merged.
MERGE_EVERY = 20


def latest_per_camera(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys=("cam_id",),
    order=("ts",),
    once=False,
    every="30 seconds",
    fold_every: int | None = keyed.FOLD_EVERY,
) -> StreamingQuery:
    """Newest row per key in Parquet; a batch writes the keys it changed. State: one row per key."""
    rest = [c for c in stream.columns if c not in keys]
    newest = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return keyed.start(newest.select(*keys, "_row.*"), path, checkpoint, tuple(keys), tuple(order), once, every, fold_every)


def read_latest(spark: SparkSession, path: str, schema, keys=("cam_id",), order=("ts",)) -> DataFrame:
    """The newest row per key; no rows if nothing is stored."""
    return keyed.read(spark, path, schema, tuple(keys), tuple(order))


def hourly_summary(
    frames: DataFrame,
    path: str,
    checkpoint: str,
    delay: str = "2 hours",
    count_vessel: bool = False,
    once: bool = False,
    every: str = "30 seconds",
    fold_every: int | None = keyed.FOLD_EVERY,
) -> StreamingQuery:
    """The hourly summary of a frame stream, kept up to date while an hour can still change.

    An hour is closed once a frame has come that is later than its end by more than `delay`: its state is
    dropped, and frames of it that come afterwards are left out and counted (`late_rows`).
    """
    hours = frames.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "cam_id")
    summed = hours.agg(*reports.hourly_figures(count_vessel)).withColumn("hour", F.col("window.start"))
    return keyed.start(reports.hourly_columns(summed, count_vessel), path, checkpoint, ("hour", "cam_id"), (), once, every, fold_every)


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    return keyed.read(spark, path, schemas.HOURLY, ("hour", "cam_id"))


def late_rows(query: StreamingQuery) -> int:
    """What came too late for its hour, over the progress reports that Spark still has (the last 100 batches).

    Spark counts behind the partial aggregation: late frames of one hour, camera and task are one.
    """
    reported = [json.loads(p.json) for p in query.recentProgress]
    return sum(s.get("numRowsDroppedByWatermark", 0) for p in reported for s in p["stateOperators"])


def live_metrics(
    entries: DataFrame, path: str, checkpoint: str, once=False, every="30 seconds", merge_every: int | None = MERGE_EVERY
) -> StreamingQuery:
    """Append result entries (text fields) to a store partitioned by date.

    A repeated batch is counted once; a new checkpoint leaves the rows of earlier runs. `read_metrics` reads
    the store; a plain read of the folder may see rows twice that were just merged.
    """
    run = run_name(entries.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = messages.live_metrics(batch).withColumn("dt", F.to_date("ts")).sortWithinPartitions("cam_id", "ts")
        manifest.append(rows, path, ("dt",), run, batch_id)
        manifest.upkeep(batch.sparkSession, path, schemas.STORED_METRICS, ("dt",), batch_id, merge_every)

    writer = entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return manifest.read(spark, path, schemas.STORED_METRICS)
