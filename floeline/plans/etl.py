"""Raw folders to cleaned tables and the hourly summary."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from floeline import schemas
from floeline.operators import cleaning, reports, zone_map
from floeline.sources import readers, scratch, tables
from floeline.sources.tables import only


@dataclass
class EtlRun:
    """What a run did: without frames nothing is written."""

    ran: bool
    wrote_detections: bool = False


def run(
    spark: SparkSession,
    frames_path: str,
    detections_path: str,
    database: str,
    location: str | None = None,
    threshold: float = 0.3,
    count_vessel: bool = False,
) -> EtlRun:
    """Clean both raw folders, overwrite the partitions they hold, rebuild the hourly table."""
    tables.create_tables(spark, database, location)
    frames = readers.raw_frames(spark, frames_path)
    detections = readers.raw_detections(spark, detections_path)
    if frames.isEmpty():
        return EtlRun(ran=False)
    return load(frames, detections, database, threshold, count_vessel)


def load(
    raw_frames: DataFrame, raw_detections: DataFrame, database: str, threshold: float = 0.3, count_vessel: bool = False
) -> EtlRun:
    has_detections = not cleaning.confident(raw_detections, threshold).isEmpty()
    if has_detections:
        kept = cleaning.clean_detections(raw_detections, threshold)
        tables.overwrite_partitions(kept, f"{database}.detections")
    frames = store_frames(raw_frames, database)
    # read again rather than cached: the summary needs four narrow columns and no pixel map
    _write_summary(frames, database, count_vessel)
    return EtlRun(ran=True, wrote_detections=has_detections)


def store_frames(raw_frames: DataFrame, database: str) -> DataFrame:
    """Overwrite the partitions that the raw frames hold, and the times of their days; gives the cleaned rows.

    The times come from the table, which may hold more cameras of a day.
    """
    spark = raw_frames.sparkSession
    frames = cleaning.clean_frames(raw_frames)
    tables.overwrite_partitions(frames, f"{database}.frames")
    path = scratch.folder(spark, "days")
    try:
        frames.select("dt").distinct().write.parquet(path)
        days = spark.read.schema("dt date").parquet(path)
        zone_map.refresh(only(spark.table(f"{database}.frames"), days, ("dt",)), database)
    finally:
        scratch.drop(spark, path)
    return frames


def refresh(
    spark: SparkSession,
    touched: DataFrame,
    frames_path: str,
    detections_path: str,
    database: str,
    threshold: float = 0.3,
    count_vessel: bool = False,
) -> None:
    """Rewrite the (dt, cam_id) partitions in `touched`, and the summary of their days.

    The raw scans read the touched partitions only. A day of the summary is computed from the frame
    table, so that the cameras that were not touched stay in it. The keys are staged, which gives the
    planner their size, and read back in `spark`: a streaming batch lives in a cloned session, and
    tables overwritten from there would leave stale file lists in the session of the caller.
    """
    path = scratch.folder(spark, "touched")
    try:
        touched.select("dt", "cam_id").distinct().write.parquet(path)
        keys = spark.read.schema("dt date, cam_id string").parquet(path)
        frames = only(readers.raw_frames(spark, frames_path), keys)
        detections = only(readers.raw_detections(spark, detections_path), keys)
        tables.overwrite_partitions(cleaning.clean_detections(detections, threshold), f"{database}.detections")
        tables.overwrite_partitions(cleaning.clean_frames(frames), f"{database}.frames")
        days = only(spark.table(f"{database}.frames"), keys, ("dt",))
        _write_summary(days, database, count_vessel)
        zone_map.refresh(days, database)
    finally:
        scratch.drop(spark, path)


def _write_summary(frames: DataFrame, database: str, count_vessel: bool) -> None:
    """Replace the days of the summary that `frames` cover."""
    hourly = reports.hourly_summary(frames, count_vessel).withColumn("dt", F.to_date("hour"))
    tables.overwrite_partitions(hourly, f"{database}.hourly_summary", ("dt",))


def start_incremental(
    spark: SparkSession,
    frames_path: str,
    detections_path: str,
    database: str,
    checkpoint: str,
    location: str | None = None,
    once: bool = True,
    every: str = "90 seconds",
    threshold: float = 0.3,
    count_vessel: bool = False,
) -> StreamingQuery:
    """Follow both raw folders and refresh what new files of either touch.

    `refresh` is a full rewrite of the touched partitions, so a repeated batch changes nothing.
    """
    tables.create_tables(spark, database, location)

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            refresh(spark, batch, frames_path, detections_path, database, threshold, count_vessel)

    def keys(path: str, schema) -> DataFrame:
        tables.ensure_folder(spark, path)
        return spark.readStream.schema(schema).parquet(path).select("dt", "cam_id")

    stream = keys(frames_path, schemas.RAW_FRAMES).unionByName(keys(detections_path, schemas.RAW_DETECTIONS))
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()
