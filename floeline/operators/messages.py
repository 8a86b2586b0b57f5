"""JSON messages to typed rows and back. All of it works on batch and streaming frames."""

from pyspark.sql import Column, DataFrame, functions as F

from floeline import schemas
from floeline.functions.times import event_time


def parse(df: DataFrame, value: str = "value", grain: str = "micro") -> DataFrame:
    """Binary or text `value` to message columns plus `event_time` and `dt`.

    Broken JSON parses to a struct of NULLs and empty input to NULL; the test on `ts` and `cam_id`
    drops both. `inline` rather than `select("m.*")`: filters on its output stay above it, so the
    text is parsed once and not again for each predicate.
    """
    message = F.from_json(F.col(value).cast("string"), schemas.MESSAGE)
    return (
        df.select(F.inline(F.array(message)))
        .where(F.col("ts").isNotNull() & F.col("cam_id").isNotNull())
        .withColumn("event_time", event_time(F.col("ts"), grain))
        .withColumn("dt", F.to_date("event_time"))
    )


def frames(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        F.col("event_time").alias("ts"),
        "cam_id",
        "ice_conc",
        "ice_severity",
        "vessel_present",
        "pixels",
        "dt",
    )


def detections(parsed: DataFrame) -> DataFrame:
    """One row per element; a message without detections gives none."""
    edges = ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    return parsed.withColumn("det", F.explode("detections")).select(
        F.col("event_time").alias("ts"),
        "cam_id",
        "det.class_name",
        "det.confidence",
        "det.area_pixels",
        # get() gives NULL past the end, where getItem() would fail under ANSI
        *[F.get("det.bbox", F.lit(i)).alias(name) for i, name in enumerate(edges)],
        "ice_conc",
        "ice_severity",
        "dt",
    )


def encode(df: DataFrame) -> DataFrame:
    """Rows with the message columns to one JSON `value` column; NULL fields are left out."""
    names = [f.name for f in schemas.FULL_MESSAGE.fields if f.name in df.columns]
    return df.select(F.to_json(F.struct(*names)).alias("value"))


def stream_name(prefix: str, cam_id: Column) -> Column:
    """Name of a per-camera stream, such as `frames:cam_a`."""
    return F.concat(F.lit(prefix + ":"), cam_id)


def pixel_map(pixels_json: Column) -> Column:
    return F.from_json(pixels_json, "map<string,int>")


def live_metrics(df: DataFrame) -> DataFrame:
    """Text fields of a result stream entry to live-metric rows."""
    return df.select(
        event_time(F.col("ts").try_cast("double")).alias("ts"),
        "cam_id",
        F.col("ice_conc").try_cast("double").alias("ice_conc"),
        F.col("ice_severity").try_cast("double").alias("ice_severity"),
        (F.col("vessel_present") == "1").alias("vessel_present"),
        "pixels_json",
    )
