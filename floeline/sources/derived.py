"""Camera telemetry derived from the driver's tables.

Every row comes from a row of `events` (or of `embeddings` for pixels) by integer arithmetic, so
any SQL engine derives the same rows.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from floeline import schemas
from floeline.functions import scoring
from floeline.functions.numbers import half_up
from floeline.functions.times import epoch_seconds
from floeline.operators.ordering import last_n_of_many

TOTAL_PIXELS = 1_000_000
EMBEDDING_SIDE = 8


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _camera():
    return F.when(F.col("user_id") % 2 == 0, schemas.CAMERAS[0]).otherwise(schemas.CAMERAS[1])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event, in three hourly regimes of ice."""
    source = events(spark, sf_dir).select(
        F.col("event_id").alias("frame_id"),
        "ts",
        "event_type",
        "value",
        _camera().alias("cam_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    h = (F.col("frame_id") * 7919 + F.col("k") * 104729) % 1000
    regime = (F.dayofmonth("ts") * 24 + F.hour("ts")) % 3
    calm = (F.col("_g") == 0) & (F.col("event_type") == "signup")
    mixed = source.withColumns({"_h": h, "_g": regime})
    areas = {
        "ice_field": F.when(calm, 0)
        .when(F.col("_g") == 0, F.col("_h") * 50)
        .when(F.col("_g") == 1, 200_000 + F.col("_h") * 200)
        .otherwise(500_000 + F.col("_h") * 200),
        "broken_ice": F.when(calm, 0).otherwise((F.col("frame_id") * 31 + F.col("k") * 17) % 1000 * 100),
        "slush_ice": F.when(calm, 0).otherwise((F.col("frame_id") * 13 + F.col("k") * 7) % 1000 * 100),
        "vessel": F.when(F.col("event_type") == "error", 50_000 + F.col("_h") * 100).otherwise(0),
    }
    sized = mixed.withColumns({name: area.cast("int") for name, area in areas.items()}).drop("_h", "_g")
    field, broken, slush, vessel = (F.col(name) for name in areas)
    total = F.lit(TOTAL_PIXELS)
    return sized.withColumns(
        {
            "total_pixels": total,
            "vessel_present": vessel > 0,
            "ice_conc": half_up(scoring.concentration(field, broken, slush, vessel, total), 4),
            "ice_severity": half_up(scoring.severity(field, broken, slush), 4),
            "dt": F.to_date("ts"),
        }
    )


def pixel_map():
    named = [F.lit(n) for n in ("ice_field", "broken_ice", "slush_ice", "vessel", "open_water", "background")]
    areas = [F.col("ice_field"), F.col("broken_ice"), F.col("slush_ice"), F.col("vessel"), F.lit(0), F.lit(0)]
    return F.create_map(*[part for pair in zip(named, areas) for part in pair])


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in the layout of the raw frame folder."""
    return frames(spark, sf_dir).select(
        "ts", "cam_id", "ice_conc", "ice_severity", "vessel_present", pixel_map().alias("pixels"), "dt"
    )


def _found(index: int, name: str):
    """Detection of one class in a frame."""
    frame = F.col("frame_id")
    x1, y1 = (frame * 3 + index * 101) % 1280, (frame * 5 + index * 53) % 720
    box = (x1, y1, x1 + 1 + frame % 200, y1 + 1 + frame % 150)
    return F.struct(
        F.lit(name).alias("class_name"),
        ((frame * 37 + index * 11 + F.col("k")) % 100 / 100).alias("confidence"),
        F.col(name).alias("area_pixels"),
        F.array(*[edge.cast("int") for edge in box]).alias("bbox"),
    )


def _found_array():
    return F.array(*[_found(i, n) for i, n in enumerate(("ice_field", "broken_ice", "slush_ice"))])


def framed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their detections as an array; classes without area are left out."""
    some = F.filter(_found_array(), lambda d: d["area_pixels"] > 0)
    return frames(spark, sf_dir).withColumn("detections", some)


def detections(spark: SparkSession, sf_dir: str, copies: bool = False) -> DataFrame:
    """One row per detection in the layout of the raw detection folder.

    With `copies`, each detection of a `purchase` frame is there twice.
    """
    spread = frames(spark, sf_dir).withColumn("d", F.explode(_found_array())).where("d.area_pixels > 0")
    if copies:
        times = F.when(F.col("event_type") == "purchase", 2).otherwise(1)
        spread = spread.withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    edges = ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    return spread.select(
        "ts",
        "cam_id",
        "d.class_name",
        "d.confidence",
        "d.area_pixels",
        *[F.get("d.bbox", F.lit(i)).alias(edge) for i, edge in enumerate(edges)],
        "ice_conc",
        "ice_severity",
        "dt",
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame and segmented class, the vessel included."""
    names = ("ice_field", "broken_ice", "slush_ice", "vessel")
    each = F.array(*[F.struct(F.lit(n).alias("class_name"), F.col(n).alias("area_pixels")) for n in names])
    spread = frames(spark, sf_dir).select("frame_id", "cam_id", "ts", "total_pixels", F.explode(each).alias("r"))
    return spread.select("frame_id", "cam_id", "ts", "total_pixels", "r.*")


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output with numeric class ids."""
    return frames(spark, sf_dir).select(
        "frame_id", "cam_id", (F.col("frame_id") % 6).cast("int").alias("class_id"), F.col("ice_field").alias("area")
    )


def timed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields a producer sends, ready for encoding."""
    source = epoch_seconds(F.col("ts"))
    return (
        framed_detections(spark, sf_dir)
        .withColumn("pixels", pixel_map())
        .withColumn("source_ts", source)
        .select(
            F.col("source_ts").alias("ts"),
            "source_ts",
            F.floor(F.col("frame_id") / 2).cast("int").alias("frame_seq"),
            (F.col("source_ts") + F.col("value") / 1000).alias("processed_ts"),
            F.col("value").alias("inference_ms"),
            "cam_id",
            "ice_conc",
            "ice_severity",
            "vessel_present",
            "pixels",
            "detections",
        )
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        "ts",
        F.when(kind == "error", "error").when(kind == "signup", "warning").otherwise("info").alias("level"),
        kind.alias("source"),
        F.col("props").alias("message"),
        _camera().alias("cam_id"),
    )


def service_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One check per user: ok without an error among the last three events."""
    checks = events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type")
    last = last_n_of_many(checks, ["user_id"], ["ts", "event_id"], 3)
    return last.groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") == 0).alias("ok"))


def broken_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which no row may come: one for every seventh event, in five kinds."""
    kinds = F.array(
        F.lit("{not json"),
        F.lit(None).cast("string"),
        F.lit(""),
        F.lit('{"ts": "yesterday", "cam_id": "cam_a", "detections": [{"class_name": "ice_field", "area_pixels": 5}]}'),
        F.concat(F.lit('{"ts": '), F.col("event_id").cast("string"), F.lit(', "ice_conc": 0.5, "detections": []}')),
    )
    kind = F.floor(F.col("event_id") / 7) % 5
    return events(spark, sf_dir).where(F.col("event_id") % 7 == 0).select(F.get(kinds, kind.cast("int")).alias("value"))


def latency_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries; two neighbouring events of one camera are one frame delivered twice."""
    return events(spark, sf_dir).select(
        _camera().alias("cam_id"),
        F.floor(F.col("event_id") / 2).alias("frame_seq"),
        (1 + F.floor(F.col("event_id") / 2) % 2).cast("int").alias("camera_count"),
        F.col("value").alias("worker_processing_ms"),
        (F.col("value") * 2 + F.col("event_id") % 7).alias("collector_delivery_ms"),
        (F.col("value") / 4).alias("inference_ms"),
    )


def scaling_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings in four sizes and two worker counts."""
    sizes = F.array(*[F.lit(n) for n in (100_000, 250_000, 500_000, 1_000_000)])
    eid = F.col("event_id")
    size = F.get(sizes, (eid % 4).cast("int")).cast("bigint")
    workers = (1 + F.floor(eid / 4) % 2).cast("int")
    return events(spark, sf_dir).select(
        size.alias("rows"),
        workers.alias("executors"),
        (F.floor(eid / 8) + 1).alias("trial"),
        (size / 1e6 / workers + F.col("value") / 1000).alias("time_s"),
    )


def masks(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    """Class codes 0 to 4 of a small square frame."""
    step = 1 + F.col("k") % 5
    steps = F.sequence(F.lit(0).cast("bigint"), step * (side * side - 1), step)
    codes = F.transform(steps, lambda at: ((F.col("frame_id") * 7 + at) % 5).cast("tinyint"))
    return frames(spark, sf_dir).select("frame_id", "cam_id", codes.alias("mask"))


def pixel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (value, saturation, b) from the elements of each embedding."""
    level = lambda e: F.floor((e.cast("double") + 1.0) * 1_000_000)
    pixel = lambda e: F.struct(
        (level(e) % 256).alias("value"),
        (F.floor(level(e) / 256) % 256).alias("saturation"),
        (F.floor(level(e) / 7) % 256).alias("b"),
    )
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id",
        F.when(F.col("vec_id") % 2 == 0, "cam_a").otherwise("cam_b").alias("cam_id"),
        F.transform("embedding", pixel).alias("pixels"),
    )


def sized_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame resolutions."""
    eid = F.col("event_id")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("frame_id"),
        (320 + eid * 37 % 3600).cast("int").alias("width"),
        (240 + eid * 53 % 2000).cast("int").alias("height"),
    )


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as digits, whole digits, ISO text and junk."""
    eid, ts = F.col("event_id"), F.col("ts")
    seconds = F.unix_seconds(ts.cast("timestamp"))
    text = (
        F.when(eid % 4 == 0, F.concat(seconds.cast("string"), F.lit(".25")))
        .when(eid % 4 == 1, seconds.cast("string"))
        .when(eid % 4 == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .otherwise(F.concat(F.lit("junk "), eid.cast("string")))
    )
    return events(spark, sf_dir).select("event_id", text.alias("raw_time"))
