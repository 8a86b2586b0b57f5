"""Queries over the live-metrics table, the streams, the service checks and the log."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from floeline import schemas
from floeline.functions.times import lag_seconds


def camera_list(spark: SparkSession, cameras=schemas.CAMERAS) -> DataFrame:
    return spark.createDataFrame([(c,) for c in cameras], "cam_id string")


def history(metrics: DataFrame, cam_id: str, limit: int = 200, cameras=schemas.CAMERAS) -> DataFrame:
    """Newest rows of one known camera; an unknown one gives no rows."""
    known = metrics.where((F.col("cam_id") == cam_id) & F.col("cam_id").isin(*cameras))
    return known.select("ts", "ice_conc", "ice_severity").orderBy(
        F.desc("ts"), "ice_conc", "ice_severity"
    ).limit(limit)


def newest(df: DataFrame, ts: str = "ts") -> Column:
    """`max(ts)` as a lazy scalar, for reports that are read at the end of the data."""
    return df.select(F.max(ts)).scalar()


def recent_stats(metrics: DataFrame, as_of: Column | None = None, hours: int = 1) -> DataFrame:
    """Trailing-window means per camera; `as_of` defaults to the current time.

    A table partitioned by `dt` is read from the day on which the window starts.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    recent = metrics.where(F.col("ts") > since)
    if "dt" in metrics.columns:
        recent = recent.where(F.col("dt") >= F.to_date(since))
    return (
        recent.groupBy("cam_id")
        .agg(
            F.count(F.lit(1)).alias("cnt"),
            F.avg("ice_conc").alias("avg_conc"),
            F.avg("ice_severity").alias("avg_sev"),
        )
    )


def rows_by_camera(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("cam_id").agg(F.count(F.lit(1)).alias("db_rows"))


def latest_by_camera(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("cam_id").agg(
        F.count(F.lit(1)).alias("db_rows"), F.max("ts").alias("last_db_ts")
    )


def stream_status(stream: DataFrame, prefix: str, keep: int | None = None) -> DataFrame:
    """Length of a stream and its newest time; `keep` is the length to which a broker trims it, if it does."""
    length = F.count(F.lit(1)) if keep is None else F.least(F.count(F.lit(1)), F.lit(keep))
    return stream.groupBy("cam_id").agg(
        length.alias(f"{prefix}_stream_len"), F.max("ts").alias(f"last_{prefix}_ts")
    )


def camera_status(
    cameras: DataFrame, frame_stream: DataFrame, result_stream: DataFrame, metrics: DataFrame
) -> DataFrame:
    """One row per camera of the list with stream lengths, table rows and presence flags."""
    joined = (
        cameras.join(stream_status(frame_stream, "frame"), "cam_id", "left")
        .join(stream_status(result_stream, "result"), "cam_id", "left")
        .join(latest_by_camera(metrics), "cam_id", "left")
        .fillna(0, ["frame_stream_len", "result_stream_len", "db_rows"])
    )
    return joined.withColumns(
        {
            "has_frames": F.col("frame_stream_len") > 0,
            "has_results": F.col("result_stream_len") > 0,
            "has_db_rows": F.col("db_rows") > 0,
        }
    )


def waiting_for_results(status: DataFrame) -> DataFrame:
    """One row: are cameras listed while none of them has a result yet?"""
    return status.agg(
        (~F.coalesce(F.bool_or("has_results"), F.lit(True))).alias("waiting")
    )


def service_health(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if("ok").alias("healthy"), F.count(F.lit(1)).alias("total"))


def recent_logs(logs: DataFrame, limit: int = 100) -> DataFrame:
    return logs.orderBy(F.desc("ts"), "source", "message").limit(limit)


def system_snapshot(
    cameras: DataFrame,
    frame_stream: DataFrame,
    result_stream: DataFrame,
    metrics: DataFrame,
    checks: DataFrame,
    as_of: Column | None = None,
) -> DataFrame:
    """Health, stream lengths, table rows and lags, one row per camera."""
    as_of = F.current_timestamp() if as_of is None else as_of
    health = service_health(checks)
    return (
        cameras.join(stream_status(frame_stream, "frame"), "cam_id", "left")
        .join(stream_status(result_stream, "result"), "cam_id", "left")
        .join(rows_by_camera(metrics), "cam_id", "left")
        .fillna(0, ["frame_stream_len", "result_stream_len", "db_rows"])
        .withColumn("ts", as_of)
        .select(
            "ts",
            "cam_id",
            health.select("healthy").scalar().cast("int").alias("healthy_services"),
            health.select("total").scalar().cast("int").alias("total_services"),
            "frame_stream_len",
            "result_stream_len",
            "db_rows",
            lag_seconds(F.col("ts"), F.col("last_frame_ts")).alias("frame_lag_sec"),
            lag_seconds(F.col("ts"), F.col("last_result_ts")).alias("result_lag_sec"),
        )
    )
