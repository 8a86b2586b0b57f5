"""Hourly summary and the seven reports over the cleaned tables."""

from pyspark.sql import Column, DataFrame, functions as F

from floeline.functions.levels import hourly_level
from floeline.functions.numbers import settled
from floeline.functions.times import hour_start
from floeline.operators import quantiles
from floeline.operators.quantiles import exact_quantiles


def hourly_figures(count_vessel: bool = False) -> list[Column]:
    """Aggregates of the frames of one hour and camera."""
    extra = [F.count_if("vessel_present").alias("vessel_frames")] if count_vessel else []
    return [
        F.avg("ice_conc").alias("avg_ice_conc"),
        F.max("ice_conc").alias("max_ice_conc"),
        F.avg("ice_severity").alias("avg_severity"),
        F.count(F.lit(1)).alias("total_frames"),
        *extra,
    ]


def hourly_columns(summed: DataFrame, count_vessel: bool = False) -> DataFrame:
    """The columns of the summary from its aggregates."""
    if not count_vessel:
        summed = summed.withColumn("vessel_frames", F.lit(0).cast("bigint"))
    return summed.withColumn("danger_level", hourly_level(F.col("avg_ice_conc"))).select(
        "hour",
        "cam_id",
        "avg_ice_conc",
        "max_ice_conc",
        "avg_severity",
        "vessel_frames",
        "total_frames",
        "danger_level",
    )


def hourly_summary(frames: DataFrame, count_vessel: bool = False) -> DataFrame:
    """By hour and camera. `vessel_frames` is 0 unless `count_vessel` asks for a real count."""
    hours = frames.groupBy(hour_start(frames, "ts").alias("hour"), "cam_id")
    return hourly_columns(hours.agg(*hourly_figures(count_vessel)), count_vessel)


def class_distribution(detections: DataFrame) -> DataFrame:
    return (
        detections.groupBy("class_name")
        .agg(
            F.count(F.lit(1)).alias("detections"),
            (F.sum("area_pixels") / F.lit(1e6)).alias("total_megapixels"),
            F.avg("confidence").alias("avg_confidence"),
        )
        .orderBy(F.desc("detections"), "class_name")
    )


def hour_of_day_profile(hourly: DataFrame) -> DataFrame:
    """Unweighted average of the hourly averages."""
    return (
        hourly.groupBy(F.hour("hour").alias("hour_of_day"), "cam_id")
        .agg(
            F.avg("avg_ice_conc").alias("mean_conc"),
            F.avg("avg_severity").alias("mean_severity"),
            F.count(F.lit(1)).alias("hours_recorded"),
        )
        .orderBy("cam_id", "hour_of_day")
    )


def danger_hours(hourly: DataFrame, limit: int = 50) -> DataFrame:
    """Newest dangerous hours; cameras of one hour in name order."""
    return (
        hourly.where(F.col("danger_level") == "danger")
        .select(
            "hour",
            "cam_id",
            settled(F.col("avg_ice_conc"), 3).alias("conc"),
            settled(F.col("avg_severity"), 3).alias("severity"),
            "total_frames",
        )
        .orderBy(F.desc("hour"), "cam_id")
        .limit(limit)
    )


def camera_means(frames: DataFrame, rows: str = "frames") -> DataFrame:
    return camera_compare(frames, rows).orderBy("cam_id")


def camera_compare(frames: DataFrame, rows: str = "total_frames") -> DataFrame:
    return frames.groupBy("cam_id").agg(
        F.count(F.lit(1)).alias(rows),
        F.avg("ice_conc").alias("mean_conc"),
        F.avg("ice_severity").alias("mean_severity"),
    )


AREA_PROBS = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def area_percentiles(detections: DataFrame) -> DataFrame:
    """Exact rank percentiles of the detection areas per class, with the largest area."""
    probs = {**AREA_PROBS, "max_area": 1.0}
    return exact_quantiles(detections, ["class_name"], "area_pixels", probs, interpolate=False).drop("n")


def area_sketches(detections: DataFrame, size: int = quantiles.SKETCH_SIZE) -> DataFrame:
    """A sketch of the areas per day and class, of bounded size: a day is read once and merged into any later report."""
    return quantiles.sketches(detections, ["dt", "class_name"], "area_pixels", size)


def area_percentiles_merged(sketches: DataFrame) -> DataFrame:
    """The same percentiles from the sketches of the days; ranks are off by `quantiles.rank_error` as a rule."""
    found = quantiles.approximate(sketches, ["class_name"], AREA_PROBS)
    return found.withColumnRenamed("largest", "max_area").drop("n")


def area_percentiles_approx(detections: DataFrame, size: int = 4000) -> DataFrame:
    """One pass over rows of which no sketches are stored."""
    return area_percentiles_merged(area_sketches(detections, size))


def daily_summary(hourly: DataFrame) -> DataFrame:
    return (
        hourly.groupBy(F.to_date("hour").alias("day"), "cam_id")
        .agg(
            F.avg("avg_ice_conc").alias("daily_avg_conc"),
            F.max("max_ice_conc").alias("daily_peak"),
            F.sum("total_frames").alias("total_frames"),
        )
        .orderBy(F.desc("day"), "cam_id")
    )
