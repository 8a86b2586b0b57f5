"""Figures over all cameras."""

from pyspark.sql import DataFrame, functions as F

from floeline.functions.levels import note_code, scene_level


def fleet_rollup(cards: DataFrame) -> DataFrame:
    """Means weighted by signal freshness, and counts of fresh, covered and live cameras."""
    weight = F.lit(0.35) + F.lit(0.65) * F.col("freshness")
    weighed = cards.withColumn("_w", weight)

    def mean(name: str):
        total = F.sum(F.col(name) * F.col("_w"))
        return F.coalesce(F.try_divide(total, F.sum("_w")), F.lit(0.0))

    return weighed.agg(
        mean("field_cover").alias("avg_field"),
        mean("ice_cover").alias("avg_ice"),
        mean("loose_share").alias("avg_loose"),
        mean("display_load").alias("avg_load"),
        F.count_if(F.col("freshness") >= 0.5).alias("fresh_cams"),
        F.count_if(F.col("field_cover") >= 0.12).alias("field_cams"),
        F.count_if(F.col("frame_count") > 0).alias("live_cams"),
    )


def top_camera(cards: DataFrame, measure: str) -> DataFrame:
    """Camera with the largest value, the first in name order on ties."""
    return cards.orderBy(F.desc(measure), "cam_id").limit(1)


def summary_note(cards: DataFrame) -> DataFrame:
    """Which sentence sums up the scene, for the camera with the heaviest load."""
    return top_camera(cards, "display_load").select(
        "cam_id",
        "scene_kind",
        scene_level(F.col("field_cover"), F.col("display_load")).alias("scene_level"),
        note_code(F.col("field_cover"), F.col("loose_share")).alias("note"),
        "field_cover",
        "display_load",
    )
