"""Scene scores from pixel counts."""

from pyspark.sql import Column, DataFrame, functions as F

from floeline import schemas
from floeline.functions.numbers import clamp01


def concentration(field: Column, broken: Column, slush: Column, vessel: Column, total: Column) -> Column:
    """Ice over the area not hidden by the vessel. Not clamped: class areas may overlap."""
    return (field + broken + slush) / F.greatest(F.lit(1), total - vessel)


def severity(field: Column, broken: Column, slush: Column) -> Column:
    ice = field + broken + slush
    weighted = broken * F.lit(schemas.BROKEN_WEIGHT) + slush * F.lit(schemas.SLUSH_WEIGHT)
    return F.when(ice > 0, weighted / ice).otherwise(F.lit(0.0))


def scene_metrics(
    df: DataFrame,
    field: str = "ice_field",
    broken: str = "broken_ice",
    slush: str = "slush_ice",
    vessel: str = "vessel",
    total: str = "total_pixels",
) -> DataFrame:
    """Add covers (over usable pixels), shares (within the ice), roughness and pressure."""
    areas = {"field": F.col(field), "broken": F.col(broken), "slush": F.col(slush)}
    counted = df.withColumns(
        {
            "usable_pixels": F.greatest(F.lit(1), F.col(total) - F.col(vessel)),
            "ice_pixels": areas["field"] + areas["broken"] + areas["slush"],
        }
    )
    ice, usable = F.col("ice_pixels"), F.col("usable_pixels")

    def share(part: Column) -> Column:
        return F.when(ice > 0, part / ice).otherwise(F.lit(0.0))

    ratios = {"ice_cover": ice / usable}
    ratios |= {f"{name}_cover": area / usable for name, area in areas.items()}
    ratios |= {f"{name}_share": share(area) for name, area in areas.items()}
    ratios["loose_share"] = share(areas["broken"] + areas["slush"])
    return (
        counted.withColumns(ratios)
        .withColumn("roughness", roughness(F.col("broken_share"), F.col("slush_share")))
        .withColumn("scene_pressure", pressure(F.col("field_cover"), F.col("ice_cover"), F.col("roughness")))
    )


def roughness(broken_share: Column, slush_share: Column) -> Column:
    return clamp01(F.lit(0.7) * broken_share + F.lit(0.3) * slush_share)


def pressure(field_cover: Column, ice_cover: Column, rough: Column) -> Column:
    return clamp01(F.lit(0.72) * field_cover + F.lit(0.18) * ice_cover + F.lit(0.10) * rough)


def display_load(field_cover: Column, scene_pressure: Column, trend: Column, fresh: Column) -> Column:
    blend = F.lit(0.72) * field_cover + F.lit(0.18) * scene_pressure + F.lit(0.10) * trend
    return clamp01(blend * (F.lit(0.9) + F.lit(0.1) * fresh))
