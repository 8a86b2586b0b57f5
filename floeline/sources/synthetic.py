"""Random detections for load tests."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from floeline.functions import counters

CLASSES = ("vessel", "ice_field", "broken_ice", "slush_ice")


def detections(spark: SparkSession, rows: int, parts: int | None = None) -> DataFrame:
    parts = parts or max(4, rows // 1_000_000)
    return from_ids(spark.range(0, rows, 1, parts), rows)


def from_ids(ids: DataFrame, seed: int) -> DataFrame:
    """Detections for the rows of `ids` (column `id`, 0 or more), cameras taking turns, over thirty days.

    A row depends on its id and the seed only, so any part can be made again, here or elsewhere.
    """
    at = F.col("id")
    names = F.array(*[F.lit(c) for c in CLASSES])
    day = F.date_add(F.lit("2024-01-01").cast("date"), counters.below(at, 1, seed, 30).cast("int"))
    return ids.select(
        F.when(at % 2 == 0, "cam_a").otherwise("cam_b").alias("cam_id"),
        (0.4 + 0.6 * counters.share(at, 2, seed)).alias("confidence"),
        (100 + counters.below(at, 3, seed, 50_000)).cast("int").alias("area_pixels"),
        counters.share(at, 4, seed).alias("ice_conc"),
        counters.share(at, 5, seed).alias("ice_severity"),
        F.date_format(day, "yyyy-MM-dd").alias("dt"),
        F.get(names, counters.below(at, 6, seed, len(CLASSES)).cast("int")).alias("class_name"),
    )
