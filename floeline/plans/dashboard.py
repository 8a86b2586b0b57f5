"""Dashboard figures: per-frame load and one card per camera."""

from pyspark.sql import Column, DataFrame, functions as F

from floeline import schemas
from floeline.functions import levels, scoring
from floeline.functions.numbers import clamp01
from floeline.functions.times import freshness, lag_seconds
from floeline.operators.ordering import last_n
from floeline.operators.trend import smooth_array, smoothed


def frame_loads(frames: DataFrame, as_of: Column, parts: int | None = None) -> DataFrame:
    """Trend, freshness and display load at every frame."""
    scored = scoring.scene_metrics(frames).select(
        "frame_id", "cam_id", "ts", clamp01(F.col("field_cover")).alias("field_cover"), "scene_pressure"
    )
    trended = smoothed(scored, "field_cover", ["cam_id"], ["ts", "frame_id"], parts=parts)
    fresh = freshness(lag_seconds(as_of, F.col("ts")))
    return trended.withColumn("freshness", fresh).withColumn(
        "display_load",
        scoring.display_load(F.col("field_cover"), F.col("scene_pressure"), F.col("trend"), F.col("freshness")),
    )


def camera_cards(frames: DataFrame, as_of: Column, cameras: DataFrame | None = None) -> DataFrame:
    """State of every camera from its newest points.

    Only the last `TREND_WINDOW` frames of a camera are gathered, so the arrays stay short. A camera
    of the list without frames shows open water, zeros and full freshness.
    """
    narrow = frames.select(
        "cam_id", "ts", "frame_id", "ice_field", "broken_ice", "slush_ice", "vessel", "total_pixels", "vessel_present"
    )
    newest = last_n(narrow, ["cam_id"], ["ts", "frame_id"], schemas.TREND_WINDOW)
    scored = scoring.scene_metrics(newest).withColumn("field_point", clamp01(F.col("field_cover")))
    latest = [
        "ts", "ice_pixels", "ice_field", "broken_ice", "slush_ice", "field_cover", "ice_cover",
        "loose_share", "field_share", "broken_cover", "slush_cover", "roughness", "scene_pressure",
        "vessel_present",
    ]
    gathered = scored.groupBy("cam_id").agg(
        F.min_by(F.struct(*latest), "rank").alias("_now"),
        F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("age"), "field_point"))).alias("_points"),
    )
    counts = frames.groupBy("cam_id").agg(F.count(F.lit(1)).alias("frame_count"))
    card = (
        gathered.select("cam_id", "_now.*", F.transform("_points", lambda p: p["field_point"]).alias("_points"))
        .withColumns(
            {
                name: clamp01(F.col(name))
                for name in ("field_cover", "ice_cover", "loose_share", "field_share", "broken_cover", "slush_cover")
            }
        )
        .withColumn("trend", smooth_array(F.col("_points")))
        .withColumn("trend_points", F.size("_points"))
        .withColumn("age_sec", lag_seconds(as_of, F.col("ts")))
        .withColumn("freshness", freshness(F.col("age_sec")))
        .withColumn(
            "display_load",
            scoring.display_load(F.col("field_cover"), F.col("scene_pressure"), F.col("trend"), F.col("freshness")),
        )
        .join(counts, "cam_id")
    )
    if cameras is not None:
        zeros = [n for n, t in card.dtypes if t in ("double", "int", "bigint") and n not in ("age_sec", "freshness")]
        card = cameras.join(card, "cam_id", "left").fillna(0, zeros).fillna(1.0, ["freshness"])
        card = card.withColumn("vessel_present", F.coalesce("vessel_present", F.lit(False)))
    kind = levels.scene_kind(F.col("ice_pixels"), F.col("field_cover"), F.col("scene_pressure"), F.col("loose_share"))
    largest = levels.largest_class(F.col("ice_field"), F.col("broken_ice"), F.col("slush_ice"))
    return card.withColumns(
        {
            "scene_kind": kind,
            "scene_level": levels.scene_level(F.col("field_cover"), F.col("display_load")),
            "label_class": levels.label_class(kind, largest),
        }
    ).drop("_points", "ice_pixels", "ice_field", "broken_ice", "slush_ice")


def scene_labels(frames: DataFrame) -> DataFrame:
    """Largest class, scene kind, level and display texts per frame."""
    scored = scoring.scene_metrics(frames)
    kind = levels.scene_kind(F.col("ice_pixels"), F.col("field_cover"), F.col("scene_pressure"), F.col("loose_share"))
    return (
        scored.withColumns(
            {
                "dominant_class": levels.largest_class(F.col("ice_field"), F.col("broken_ice"), F.col("slush_ice")),
                "scene_kind": kind,
                "scene_level": levels.scene_level(F.col("field_cover"), F.col("scene_pressure")),
            }
        )
        .withColumn("label_class", levels.label_class(F.col("scene_kind"), F.col("dominant_class")))
        .withColumns(
            {
                "scene_label": levels.scene_text(F.col("scene_kind")),
                "dominant_label": levels.class_text(F.col("label_class")),
            }
        )
    )
