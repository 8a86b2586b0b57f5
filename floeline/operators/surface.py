"""Pixel operators over frames that carry their pixels as arrays."""

from pyspark.sql import DataFrame, functions as F

from floeline import schemas
from floeline.functions import masks
from floeline.functions.geometry import rescale_area, rescale_edge
from floeline.functions.levels import text
from floeline.functions.solid import solid_mask
from floeline.operators.zones import blocked_pixels


def mask_histogram(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Pixels per class code, and the total."""
    counts = {f"{name}_pixels": masks.code_count(F.col(mask), code) for name, code in schemas.MASK_CODES.items()}
    return df.withColumns({"total_pixels": F.size(mask), **counts}).withColumn(
        "usable_pixels", F.greatest(F.lit(1), F.col("total_pixels") - F.col("vessel_pixels"))
    )


def region_boxes(df: DataFrame, keys: list[str], width: int, mask: str = "mask") -> DataFrame:
    """Box and pixel count per frame and ice class; a class without pixels gives no row.

    The pixels of a frame come from one row, so the partial aggregate leaves at most one row per
    frame and class for the shuffle.
    """
    names = {code: name for name, code in schemas.MASK_CODES.items() if name != "vessel"}
    pixels = df.select(*keys, F.posexplode(mask).alias("_at", "_code")).where(F.col("_code").isin(*names))
    column = F.col("_at") % width
    boxed = pixels.groupBy(*keys, "_code").agg(
        F.min(column).alias("bbox_x1"),
        F.min("_at").alias("_top"),
        F.max(column).alias("bbox_x2"),
        F.max("_at").alias("_bottom"),
        F.count(F.lit(1)).cast("int").alias("area_pixels"),
    )
    class_name = F.coalesce(*[F.when(F.col("_code") == code, name) for code, name in names.items()])
    return boxed.select(
        *keys,
        class_name.alias("class_name"),
        "bbox_x1",
        F.floor(F.col("_top") / width).cast("int").alias("bbox_y1"),
        "bbox_x2",
        F.floor(F.col("_bottom") / width).cast("int").alias("bbox_y2"),
        "area_pixels",
    )


def solid_regions(df: DataFrame, keys: list[str], width: int, kernels: dict[str, int] = schemas.CLOSING, mask: str = "mask") -> DataFrame:
    """Boxes and pixel counts per frame and class after holes were filled and gaps closed.

    `kernels` has the size of the closing kernel of each class that is made solid; vessel pixels stay what
    they are, and a pixel that two classes reach belongs to the first of them.
    """
    codes = schemas.MASK_CODES
    classes = {codes[name]: size for name, size in kernels.items()}
    solid = df.withColumn(mask, solid_mask(F.col(mask).cast("array<int>"), width, classes, codes["vessel"]))
    return region_boxes(solid, keys, width, mask)


def mask_detections(
    df: DataFrame, keys: list[str], width: int, height: int, full_width: int, full_height: int, mask: str = "mask"
) -> DataFrame:
    """One detection per ice class of a mask, in the full resolution, with the fixed confidences."""
    small = [F.lit(width), F.lit(height)]
    full = [F.lit(full_width), F.lit(full_height)]
    sides = {"bbox_x1": 0, "bbox_y1": 1, "bbox_x2": 0, "bbox_y2": 1}
    return region_boxes(df, keys, width, mask).select(
        *keys,
        "class_name",
        text(F.col("class_name"), schemas.MASK_CONFIDENCE).alias("confidence"),
        rescale_area(F.col("area_pixels"), *small, *full).alias("area_pixels"),
        *[rescale_edge(F.col(name), small[i], full[i]).alias(name) for name, i in sides.items()],
    )


def median_split(
    df: DataFrame,
    keys: list[str],
    width: int,
    height: int,
    pixels: str = "pixels",
    cam_id: str = "cam_id",
    least_pixels: int = 800,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Split the candidate pixels of each frame into an ice and a slush class.

    `pixels` is a row-major array of (value, saturation, b). Candidates are bright, weakly
    saturated and within the middle rows. They are cut at the median score; when a side gets too
    few, at the 40th and 60th percentile; when both still do, by column. `edges` (see `zones`) keeps
    pixels out whose centre lies in the zone of the camera.
    """
    if edges is not None:
        # the zone of a camera is tested once for each pixel, not for each frame
        df = df.join(blocked_pixels(edges, width, height).withColumnRenamed("cam_id", cam_id), cam_id, "left")
    top, bottom = int(height * 0.18), int(height * 0.97)
    enough = max(least_pixels, int(height * width * 0.01)) // 4

    def candidate(p, i):
        row = F.floor(i / width)
        passed = (row >= top) & (row < bottom) & (p["value"] > 72) & (p["saturation"] < 190)
        if edges is None:
            return passed
        return passed & ~F.coalesce(F.get(F.col("blocked"), i), F.lit(False))

    kept = F.transform(
        F.col(pixels),
        lambda p, i: F.when(
            candidate(p, i),
            F.struct(
                (i % width).alias("x"),
                (p["b"].cast("double") - F.lit(0.18) * p["saturation"]).alias("score"),
            ),
        ),
    )
    cut = (
        df.select(*keys, F.col(cam_id).alias("_cam"), F.filter(kept, lambda s: s.isNotNull()).alias("_kept"))
        .withColumn("_sorted", F.array_sort(F.transform("_kept", lambda s: s["score"])))
        .select(
            *keys,
            "_cam",
            "_kept",
            F.size("_kept").alias("candidates"),
            masks.sorted_quantile(F.col("_sorted"), 0.5).alias("split"),
            masks.sorted_quantile(F.col("_sorted"), 0.4).alias("low"),
            masks.sorted_quantile(F.col("_sorted"), 0.6).alias("high"),
        )
    )

    def count(test):
        return F.size(F.filter("_kept", test))

    left, right = int(width * 0.56), int(width * 0.44)
    ice_side = F.when(F.col("_cam") == "cam_a", count(lambda s: s["x"] < left)).otherwise(
        count(lambda s: s["x"] > right)
    )
    by_median = (count(lambda s: s["score"] <= F.col("split")), count(lambda s: s["score"] > F.col("split")))
    by_tails = (count(lambda s: s["score"] <= F.col("low")), count(lambda s: s["score"] >= F.col("high")))
    sized = cut.withColumns(
        {
            "_m_ice": by_median[0],
            "_m_slush": by_median[1],
            "_t_ice": by_tails[0],
            "_t_slush": by_tails[1],
            "_c_ice": ice_side,
        }
    )
    rule = (
        F.when(F.col("candidates") == 0, "none")
        .when((F.col("_m_ice") >= enough) & (F.col("_m_slush") >= enough), "median")
        .when((F.col("_t_ice") >= enough) | (F.col("_t_slush") >= enough), "tails")
        .otherwise("columns")
    )

    def pick(median, tails, columns):
        chosen = F.when(F.col("rule") == "median", median).when(F.col("rule") == "tails", tails)
        return chosen.otherwise(columns)

    return sized.withColumn("rule", rule).select(
        *keys,
        "candidates",
        "rule",
        "split",
        "low",
        "high",
        pick(F.col("_m_ice"), F.col("_t_ice"), F.col("_c_ice")).alias("ice_pixels"),
        pick(F.col("_m_slush"), F.col("_t_slush"), F.col("candidates") - F.col("_c_ice")).alias("slush_pixels"),
    )
