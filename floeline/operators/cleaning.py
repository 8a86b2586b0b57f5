"""Cleaning of raw frames and detections."""

from pyspark.sql import DataFrame, functions as F

from floeline import schemas
from floeline.functions import scoring

# `dt` follows from `ts`; having it in the key lets date filters pass below the aggregate.
DETECTION_KEY = ["dt", "ts", "cam_id", "class_name", "bbox_x1", "bbox_y1"]


def confident(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    return df.where(F.col("confidence") > threshold)


def drop_duplicates(df: DataFrame, keys: list[str] = DETECTION_KEY) -> DataFrame:
    """One row per key, the same one on every run: the largest by the remaining columns.

    An aggregate, not a window: copies collapse before the shuffle, so a key that holds a third
    of all rows costs one row per input task.
    """
    first = ["confidence", "area_pixels", "bbox_x2", "bbox_y2"]
    rest = [c for c in first if c in df.columns and c not in keys]
    rest += [c for c in df.columns if c not in keys and c not in rest]
    best = F.max(F.struct(*rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def clean_detections(raw: DataFrame, threshold: float = 0.3) -> DataFrame:
    kept = drop_duplicates(confident(raw, threshold))
    return kept.select(
        "ts",
        "class_name",
        "confidence",
        "area_pixels",
        "bbox_x1",
        "bbox_y1",
        "bbox_x2",
        "bbox_y2",
        "ice_conc",
        "ice_severity",
        "dt",
        "cam_id",
    )


def clean_frames(raw: DataFrame) -> DataFrame:
    """Flatten the pixel map early: Parquet cannot prune inside a map."""
    areas = {
        "vessel_area": "vessel",
        "ice_field_area": "ice_field",
        "broken_ice_area": "broken_ice",
        "slush_ice_area": "slush_ice",
    }
    return raw.select(
        "ts",
        "ice_conc",
        "ice_severity",
        "vessel_present",
        *[F.col("pixels")[key].alias(name) for name, key in areas.items()],
        "dt",
        "cam_id",
    )


def tracked_only(df: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Name the model class and keep the tracked ones."""
    rows = [(i, name) for i, name in schemas.CLASS_NAMES.items() if name in schemas.TRACKED_CLASSES]
    classes = df.sparkSession.createDataFrame(rows, f"{class_id} int, class_name string")
    return df.join(F.broadcast(classes), class_id)


def frame_totals(regions: DataFrame, keys: list[str], total_pixels: str = "total_pixels") -> DataFrame:
    """Class areas per frame from one row per region (overlaps add up), with both scores."""
    sums = {
        name: F.coalesce(F.sum(F.when(F.col("class_name") == name, F.col("area_pixels"))), F.lit(0))
        for name in ("ice_field", "broken_ice", "slush_ice", "vessel")
    }
    summed = regions.groupBy(*keys).agg(
        *[total.alias(name) for name, total in sums.items()], F.max(total_pixels).alias("total_pixels")
    )
    field, broken, slush, vessel = (F.col(c) for c in sums)
    return summed.withColumns(
        {
            "ice_conc": scoring.concentration(field, broken, slush, vessel, F.col("total_pixels")),
            "ice_severity": scoring.severity(field, broken, slush),
            "vessel_present": vessel > 0,
        }
    )
