"""Camera zones."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from floeline import schemas
from floeline.functions.geometry import inside, near, outline


def zone_edges(spark: SparkSession, zones: dict = schemas.SCORING_ZONES) -> DataFrame:
    """One row per camera with the closed outline as an array of edges.

    Literals tell the planner their size, so that it broadcasts them instead of dealing all points by their few cameras.
    """
    def edge(a, b):
        return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*a, *b))])

    rows = [
        F.struct(F.lit(cam).alias("cam_id"), F.array(*[edge(*pair) for pair in zip(points, [*points[1:], points[0]])]).alias("edges"))
        for cam, points in zones.items()
    ]
    typed = F.array(*rows).cast("array<struct<cam_id:string,edges:array<struct<x1:double,y1:double,x2:double,y2:double>>>>")
    return spark.range(1, numPartitions=1).select(F.inline(typed))


def mark_zone(df: DataFrame, edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Add `in_zone` for normalised points; a camera without a zone has none inside."""
    joined = df.join(edges, "cam_id", "left")
    return joined.withColumn("in_zone", inside(F.col(x), F.col(y), F.col("edges"))).drop("edges")


def mark_widened(
    df: DataFrame, edges: DataFrame, width: int, height: int, size: int = schemas.ZONE_WIDENING, x: str = "x", y: str = "y"
) -> DataFrame:
    """Add `in_zone` and `in_widened` for normalised points of frames of width x height pixels.

    The zone is widened by a round kernel of `size` pixels (an even size is taken one larger): all that lies
    within half of it from the outline belongs to it too.
    """
    reach = (size | 1) // 2
    joined = df.join(edges.withColumn("_outline", outline(F.col("edges"), width, height, reach)), "cam_id", "left")
    px, py = F.col(x), F.col(y)
    joined = joined.withColumn("in_zone", inside(px, py, F.col("edges")))
    wide = F.col("in_zone") | near(px, py, F.col("_outline"), width, height, reach)
    return joined.withColumn("in_widened", wide).drop("edges", "_outline")


def blocked_pixels(edges: DataFrame, width: int, height: int, widen: int = 0) -> DataFrame:
    """One row per camera with a row-major array of flags: does the centre of the pixel lie in the zone?

    With `widen`, in the zone widened by a kernel of that size.
    """
    reach = (widen | 1) // 2

    def flag(i):
        x, y = (i % width + 0.5) / width, (F.floor(i / width) + 0.5) / height
        found = inside(x, y, F.col("edges"))
        return found | near(x, y, outline(F.col("edges"), width, height, reach), width, height, reach) if widen else found

    every = F.sequence(F.lit(0), F.lit(width * height - 1))
    return edges.select("cam_id", F.transform(every, flag).alias("blocked"))
