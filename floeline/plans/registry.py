"""Registered queries: each reads the driver's tables whole and returns a DataFrame.

Doubles that depend on summation order or on a maths library are snapped to a fine binary grid, so
that the same query in another engine gives the same bits. Dates are given as ISO text.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from floeline import schemas
from floeline.functions import geometry, levels, scoring, times
from floeline.operators import cleaning, experiment, live, messages, reports, rollup, surface, trend, zone_map, zones
from floeline.plans import dashboard, etl, model
from floeline.sources import derived, readers, scratch, synthetic, tables
from floeline.streaming import normaliser
from floeline.streaming import tables as stream_tables

GRID = 1_048_576.0  # 2 ** 20


def snap(value: Column) -> Column:
    return F.floor(value * GRID + 0.5) / GRID


def snapped(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: snap(F.col(n)) for n in names})


def iso_date(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


# --- inputs the reports share -------------------------------------------------


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    return reports.hourly_summary(derived.frames(spark, sf))


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_detections(derived.detections(spark, sf, copies=True))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return derived.frames(spark, sf).select("ts", "cam_id", "ice_conc", "ice_severity")


def _cards(spark: SparkSession, sf: str) -> DataFrame:
    frames = derived.frames(spark, sf)
    return dashboard.camera_cards(frames, live.newest(frames), _cameras(spark))


# --- reports ------------------------------------------------------------------


def hourly_summary(spark, sf):
    return snapped(_hourly(spark, sf), "avg_ice_conc", "avg_severity")


def hourly_vessels(spark, sf):
    counted = reports.hourly_summary(derived.frames(spark, sf), count_vessel=True)
    return counted.select("hour", "cam_id", "vessel_frames", "total_frames", "danger_level")


def danger_hours(spark, sf):
    return reports.danger_hours(_hourly(spark, sf))


def class_distribution(spark, sf):
    return snapped(reports.class_distribution(_cleaned(spark, sf)), "total_megapixels", "avg_confidence")


def area_percentiles(spark, sf):
    return reports.area_percentiles(_cleaned(spark, sf))


def area_percentile_ranks(spark, sf):
    """Where the approximate percentiles really stand: shares of the rows up to each, in whole per cent.

    The sketches are stored per day and merged from there.
    """
    cleaned = _cleaned(spark, sf)
    stored = scratch.folder(spark, "sketches")
    reports.area_sketches(cleaned, size=4000).write.partitionBy("dt").parquet(stored)
    approx = reports.area_percentiles_merged(spark.read.parquet(stored))
    rows = cleaned.select("class_name", "area_pixels").join(approx, "class_name")
    shares = {name: F.count_if(F.col("area_pixels") <= F.col(name)) / F.count(F.lit(1)) for name in reports.AREA_PROBS}
    return rows.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("areas"),
        F.max("max_area").cast("int").alias("max_area"),
        *[F.floor(share * 100 + 0.5).alias(f"{name}_rank") for name, share in shares.items()],
    )


def hour_of_day_profile(spark, sf):
    return snapped(reports.hour_of_day_profile(_hourly(spark, sf)), "mean_conc", "mean_severity")


def daily_summary(spark, sf):
    return iso_date(snapped(reports.daily_summary(_hourly(spark, sf)), "daily_avg_conc"), "day")


def camera_means(spark, sf):
    return snapped(reports.camera_means(derived.frames(spark, sf)), "mean_conc", "mean_severity")


def camera_compare(spark, sf):
    return snapped(reports.camera_compare(derived.frames(spark, sf)), "mean_conc", "mean_severity")


# --- live store ---------------------------------------------------------------


def camera_history(spark, sf):
    return live.history(_metrics(spark, sf), "cam_a")


def recent_stats(spark, sf):
    metrics = _metrics(spark, sf)
    return snapped(live.recent_stats(metrics, live.newest(metrics)), "avg_conc", "avg_sev")


def _streams(spark, sf):
    """Frame stream, result stream and stored rows."""
    frames = derived.frames(spark, sf)
    return frames, frames, frames


def _cameras(spark):
    return live.camera_list(spark, [*schemas.CAMERAS, "cam_c"])


def camera_status(spark, sf):
    return live.camera_status(_cameras(spark), *_streams(spark, sf))


def waiting_alert(spark, sf):
    """Over all cameras, and over those that have never sent a frame."""
    status = camera_status(spark, sf)
    silent = status.where(F.col("cam_id") == "cam_c")
    answers = [live.waiting_for_results(part).select(F.lit(name).alias("cameras"), "waiting") for name, part in (("all", status), ("silent", silent))]
    return answers[0].unionByName(answers[1])


def camera_rows(spark, sf):
    return live.rows_by_camera(_metrics(spark, sf))


def service_health(spark, sf):
    return live.service_health(derived.service_checks(spark, sf))


def system_snapshot(spark, sf):
    streams = _streams(spark, sf)
    checks = derived.service_checks(spark, sf)
    shot = live.system_snapshot(_cameras(spark), *streams, checks, live.newest(streams[0]))
    return snapped(shot, "frame_lag_sec", "result_lag_sec")


def recent_logs(spark, sf):
    return live.recent_logs(derived.logs(spark, sf))


# --- messages and cleaning ----------------------------------------------------


def _parsed(spark, sf):
    """Parsed messages of all frames, with broken ones among them."""
    return messages.parse(messages.encode(derived.timed_messages(spark, sf)).unionByName(derived.broken_messages(spark, sf)))


def _flat_frames(df: DataFrame) -> DataFrame:
    """Frames with the pixel map laid out, and wall-clock times as in `events`."""
    keys = ("ice_field", "broken_ice", "slush_ice", "vessel", "open_water", "background")
    return df.select(
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "cam_id",
        "ice_conc",
        "ice_severity",
        "vessel_present",
        *[F.col("pixels")[k].alias(k) for k in keys],
        F.date_format("dt", "yyyy-MM-dd").alias("dt"),
    )


def _wall(df: DataFrame) -> DataFrame:
    return iso_date(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "dt")


def messages_to_frames(spark, sf):
    return _flat_frames(messages.frames(_parsed(spark, sf)))


def messages_to_detections(spark, sf):
    return _wall(messages.detections(_parsed(spark, sf)))


def clean_detections(spark, sf):
    return _wall(_cleaned(spark, sf))


def clean_frames(spark, sf):
    return _wall(cleaning.clean_frames(derived.raw_frames(spark, sf)))


def tracked_detections(spark, sf):
    return cleaning.tracked_only(derived.model_rows(spark, sf))


def frame_totals(spark, sf):
    regions = derived.regions(spark, sf)
    return snapped(cleaning.frame_totals(regions, ["frame_id", "cam_id"]), "ice_conc", "ice_severity")


# --- scores and levels --------------------------------------------------------

_COVERS = ["ice_cover", "field_cover", "broken_cover", "slush_cover"]
_SHARES = ["field_share", "broken_share", "slush_share", "loose_share"]


def scene_kpis(spark, sf):
    scored = scoring.scene_metrics(derived.frames(spark, sf))
    return scored.select(
        "frame_id", "usable_pixels", "ice_pixels", *_COVERS, *_SHARES, "roughness", "scene_pressure"
    )


def scene_labels(spark, sf):
    return dashboard.scene_labels(derived.frames(spark, sf)).select(
        "frame_id", "dominant_class", "scene_kind", "scene_level", "scene_label", "dominant_label"
    )


def frame_levels(spark, sf):
    return derived.frames(spark, sf).select(
        "frame_id",
        "ice_conc",
        "ice_severity",
        levels.frame_level(F.col("ice_conc"), F.col("ice_severity")).alias("danger_level"),
    )


def metric_levels(spark, sf):
    return scoring.scene_metrics(derived.frames(spark, sf)).select(
        "frame_id",
        levels.field_level(F.col("field_cover")).alias("field_level"),
        levels.ice_level(F.col("ice_cover")).alias("ice_level"),
        levels.loose_level(F.col("loose_share")).alias("loose_level"),
    )


def queue_lag(spark, sf):
    sent = derived.timed_messages(spark, sf)
    age = (F.col("processed_ts") - F.col("source_ts")) * 25
    return sent.select(
        "ts",
        "cam_id",
        times.queue_age_ms(F.col("processed_ts"), F.col("source_ts")).alias("queue_age_ms"),
        snap(times.mask_lag_sec(F.col("ts"), F.col("processed_ts") - 0.05)).alias("mask_lag_sec"),
        times.mask_is_fresh(age).alias("mask_fresh"),
    )


def parsed_times(spark, sf):
    parsed = times.parse_text_time(F.col("raw_time"))
    return derived.time_texts(spark, sf).select(
        "event_id",
        parsed.cast("timestamp_ntz").alias("parsed_ts"),
        times.wall_clock(parsed).alias("shown"),
    )


# --- trends and rollups -------------------------------------------------------


def field_trend(spark, sf):
    scored = scoring.scene_metrics(derived.frames(spark, sf))
    narrow = scored.select("cam_id", "ts", "frame_id", "field_cover")
    return trend.smoothed(narrow, "field_cover", ["cam_id"], ["ts", "frame_id"])


def display_load(spark, sf):
    frames = derived.frames(spark, sf)
    loads = dashboard.frame_loads(frames, live.newest(frames))
    return snapped(loads.select("frame_id", "trend", "freshness", "display_load"), "freshness", "display_load")


def camera_cards(spark, sf):
    cards = _cards(spark, sf).drop("vessel_present")
    doubles = [n for n, t in cards.dtypes if t == "double"]
    return snapped(cards, *doubles)


def fleet_rollup(spark, sf):
    return snapped(rollup.fleet_rollup(_cards(spark, sf)), "avg_field", "avg_ice", "avg_loose", "avg_load")


def worst_camera(spark, sf):
    cards = _cards(spark, sf)
    picks = [
        rollup.top_camera(cards, measure).select(
            F.lit(measure).alias("measure"), "cam_id", snap(F.col(measure)).alias("top_value")
        )
        for measure in ("display_load", "field_cover")
    ]
    return picks[0].unionByName(picks[1])


def summary_note(spark, sf):
    return snapped(rollup.summary_note(_cards(spark, sf)), "field_cover", "display_load")


def latest_per_camera(spark, sf):
    narrow = derived.frames(spark, sf).select("cam_id", "ts", "frame_id", "ice_conc", "ice_severity")
    return trend.latest(narrow, ["cam_id"], ["ts", "frame_id"])


def last_n_points(spark, sf):
    narrow = derived.frames(spark, sf).select("cam_id", "ts", "frame_id", "ice_conc")
    return trend.last_n(narrow, ["cam_id"], ["ts", "frame_id"], schemas.TREND_POINTS)


def trend_card(spark, sf):
    scored = scoring.scene_metrics(derived.frames(spark, sf))
    card = trend.trend_card(scored, "field_cover", ["cam_id"], ["ts", "frame_id"])
    return snapped(card, "mean_value")


def _frame_store(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The frame table by day and camera, and the times of its partitions; the second half of the month comes late and first."""
    database, middle = scratch.database(spark), F.lit("2024-01-16").cast("date")
    tables.create_tables(spark, database, scratch.folder(spark, "warehouse"))
    raw = _as_raw(derived.raw_frames(spark, sf))
    etl.store_frames(raw.where(F.col("dt") >= middle), database)
    etl.store_frames(raw.where(F.col("dt") < middle), database)
    return spark.table(f"{database}.frames"), zone_map.stored(spark, database)


def stored_last_points(spark, sf):
    """The newest points of each camera from the few partitions that hold them."""
    rows = zone_map.newest_of(*_frame_store(spark, sf), ["cam_id"], ["ts"], schemas.TREND_POINTS)
    return rows.select("cam_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "ice_conc", "ice_severity", "rank")


def stored_trend_card(spark, sf):
    kept = zone_map.newest_of(*_frame_store(spark, sf), ["cam_id"], ["ts"], schemas.TREND_POINTS)
    return snapped(trend.card_of(kept, "ice_conc", ["cam_id"]), "mean_value")


def stored_recent_stats(spark, sf):
    """The trailing hour, and all rows per camera without reading them."""
    table, zone_rows = _frame_store(spark, sf)
    as_of = zone_map.latest(zone_rows)
    start = as_of - F.make_dt_interval(hours=F.lit(1))
    recent = live.recent_stats(zone_map.since(table, zone_rows, start, ["cam_id"]), as_of)
    joined = zone_map.totals(zone_rows, ["cam_id"]).join(recent, "cam_id", "left")
    return snapped(joined.withColumn("last_db_ts", F.col("last_db_ts").cast("timestamp_ntz")), "avg_conc", "avg_sev")


def skip_repeats(spark, sf):
    narrow = derived.frames(spark, sf).select(
        "cam_id", "ts", "frame_id", F.floor(F.col("frame_id") / 2).alias("msg_id")
    )
    return trend.skip_repeats(narrow, ["cam_id"], ["ts", "frame_id"], "msg_id")


def frame_milestones(spark, sf):
    narrow = derived.frames(spark, sf).select("cam_id", "ts", "frame_id")
    return trend.milestones(narrow, ["cam_id"], ["ts", "frame_id"], 50)


# --- pixels, boxes, zones -----------------------------------------------------


def mask_histogram(spark, sf):
    return surface.mask_histogram(derived.masks(spark, sf)).drop("mask")


def region_bbox(spark, sf):
    return surface.region_boxes(derived.masks(spark, sf), ["frame_id"], 8)


def mask_detections(spark, sf):
    return surface.mask_detections(derived.masks(spark, sf), ["frame_id"], 8, 8, 1001, 701)


def median_split(spark, sf):
    side = derived.EMBEDDING_SIDE
    frames, edges = derived.pixel_frames(spark, sf), zones.zone_edges(spark, schemas.DISPLAY_ZONES)
    split = surface.median_split(frames, ["vec_id"], side, side, least_pixels=40, edges=edges)
    return snapped(split, "split", "low", "high")


def zone_filter(spark, sf):
    boxes = derived.detections(spark, sf).select(
        "ts",
        "cam_id",
        "class_name",
        ((F.col("bbox_x1") + F.col("bbox_x2")) / 2560.0).alias("x"),
        ((F.col("bbox_y1") + F.col("bbox_y2")) / 1440.0).alias("y"),
    )
    return zones.mark_zone(boxes, zones.zone_edges(spark))


def zone_widened(spark, sf):
    """Centres of boxes against the zones and the zones widened by the kernel, in frames of 1280 x 720."""
    boxes = derived.detections(spark, sf).select(
        "ts",
        "cam_id",
        "class_name",
        ((F.col("bbox_x1") + F.col("bbox_x2")) / 2560.0).alias("x"),
        ((F.col("bbox_y1") + F.col("bbox_y2")) / 1440.0).alias("y"),
    )
    return zones.mark_widened(boxes, zones.zone_edges(spark), 1280, 720)


def solid_regions(spark, sf):
    kernels = {"ice_field": 5, "broken_ice": 3, "slush_ice": 3}
    return surface.solid_regions(derived.masks(spark, sf), ["frame_id"], 8, kernels)


def box_rescale(spark, sf):
    found = derived.detections(spark, sf)
    src, dst = (F.lit(512), F.lit(288)), (F.lit(1920), F.lit(1080))
    return found.select(
        "ts",
        "class_name",
        geometry.rescale_area(F.floor(F.col("area_pixels") / 100), *src, *dst).alias("area_pixels"),
        *[
            geometry.rescale_edge(F.col(name), src[i % 2], dst[i % 2]).alias(name)
            for i, name in enumerate(("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"))
        ],
    )


def box_mirror(spark, sf):
    edges = ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    left, right = geometry.mirror_box(*[F.col(c) for c in edges], F.lit(1280))
    found = derived.detections(spark, sf).select("ts", "class_name", *edges)
    return found.withColumns({"bbox_x1": left, "bbox_x2": right})


def fit_dimensions(spark, sf):
    w, h = F.col("width"), F.col("height")
    model_w, model_h = geometry.fit_longest_side(w, h, 512)
    shown_w, shown_h = geometry.fit_box(w, h, 680, 382)
    return derived.sized_frames(spark, sf).select(
        "frame_id",
        model_w.alias("model_width"),
        model_h.alias("model_height"),
        shown_w.alias("shown_width"),
        shown_h.alias("shown_height"),
    )


# --- experiment ---------------------------------------------------------------


def class_camera_rollup(spark, sf):
    rolled = experiment.class_camera_rollup(derived.detections(spark, sf))
    return snapped(rolled, "avg_confidence", "avg_ice_conc")


def _published(trials: DataFrame) -> DataFrame:
    """Sent frames and window length, which a live run would report itself."""
    return trials.groupBy("camera_count").agg(
        F.ceil(F.count(F.lit(1)) * 1.25).alias("published_measured"), F.lit(600.0).alias("window_sec")
    )


def latency_summary(spark, sf):
    trials = derived.latency_trials(spark, sf)
    summary = experiment.latency_summary(trials, _published(trials))
    return snapped(summary, *[n for n, t in summary.dtypes if t == "double" and n != "window_sec"])


def latency_from_csv(spark, sf):
    """The same summary of trials that were written as CSV and read with the declared schema."""
    path = scratch.folder(spark, "trials")
    seconds = {name: F.lit(None).cast("double") for name in ("source_ts", "processed_ts", "received_ts")}
    trials = derived.latency_trials(spark, sf).withColumns(seconds)
    trials.select(*schemas.LATENCY_TRIALS.names).write.csv(path, header=True)
    stored = readers.latency_trials(spark, path)
    summary = experiment.latency_summary(stored, _published(stored))
    return snapped(summary, *[n for n, t in summary.dtypes if t == "double" and n != "window_sec"])


def latency_distinct(spark, sf):
    trials = derived.latency_trials(spark, sf)
    return snapped(experiment.distinct_frames(trials, _published(trials)), "drop_rate").drop("window_sec")


def _by_workers(spark, sf):
    trials = derived.scaling_trials(spark, sf)
    return [trials.where(F.col("executors") == n) for n in (1, 2)]


def joined_trials(spark, sf):
    return snapped(experiment.join_trials(*_by_workers(spark, sf)), "time_s")


def trial_summary(spark, sf):
    summary = experiment.trial_summary(derived.scaling_trials(spark, sf))
    return snapped(summary, *[n for n in summary.columns if n.startswith("time_")])


def speedup_pivot(spark, sf):
    summary = experiment.trial_summary(derived.scaling_trials(spark, sf))
    return snapped(experiment.speedup_pivot(summary, [1, 2]), "speedup_2")


def linearity(spark, sf):
    fit = experiment.linearity(experiment.trial_summary(derived.scaling_trials(spark, sf)))
    return fit.withColumns({"r2": snap(F.col("r2")), "seconds_per_row": snap(F.col("seconds_per_row") * 1e6)})


def shuffled_trials(spark, sf):
    """The trials with their place in the seeded order; no two have the same."""
    trials = derived.scaling_trials(spark, sf)
    sizes = F.array(*[F.lit(n) for n in (100_000, 250_000, 500_000, 1_000_000)])
    index = (F.col("trial") - 1) * 8 + (F.col("executors") - 1) * 4 + F.array_position(sizes, F.col("rows").cast("int")) - 1
    return experiment.shuffled(trials, 42, index).select("rows", "executors", "trial", "run_order_key")


def _random_detections(spark, sf):
    ids = derived.events(spark, sf).select(F.col("event_id").alias("id"))
    return synthetic.from_ids(ids, 7)


def synthetic_detections(spark, sf):
    return _random_detections(spark, sf)


def synthetic_profile(spark, sf):
    return (
        _random_detections(spark, sf)
        .groupBy("cam_id", "class_name")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("dt").alias("days"),
            snap(F.min("confidence")).alias("least_confidence"),
            snap(F.max("confidence")).alias("largest_confidence"),
            F.min("area_pixels").alias("least_area"),
            F.max("area_pixels").alias("largest_area"),
            F.sum("area_pixels").alias("area"),
            snap(F.avg("ice_conc")).alias("mean_conc"),
            snap(F.avg("ice_severity")).alias("mean_severity"),
        )
    )


def _model_tables(spark, sf):
    areas = {name: f"{name}_area" for name in ("vessel", "ice_field", "broken_ice", "slush_ice")}
    return _hourly(spark, sf), derived.frames(spark, sf).withColumnsRenamed(areas)


def training_rows(spark, sf):
    hourly, _ = _model_tables(spark, sf)
    rows, _, source = model.choose_rows("hourly_summary", hourly=hourly)
    doubles = [n for n, t in rows.dtypes if t == "double" and n.startswith("avg_")]
    return snapped(rows, *doubles).withColumn("source_table", F.lit(source))


def training_frames(spark, sf):
    _, frames = _model_tables(spark, sf)
    rows, _, source = model.choose_rows("frames", frames=frames)
    return rows.withColumn("source_table", F.lit(source))


def danger_model_sweep(spark, sf):
    """The sweep written over the table of an earlier one and read back, beside what a constant answer reaches.

    `reached` is the accuracy, but at most that share: the two are equal where the classifier is no worse.
    """
    _, frames = _model_tables(spark, sf)
    database = scratch.database(spark)
    tables.create_tables(spark, database, scratch.folder(spark, "warehouse"))
    rows, features, source = model.choose_rows("frames", frames=frames, key="frame_id")
    dealt = model.dealt_rows(rows, features, "frame_id")
    result = model.sweep_dealt(dealt, features, source)
    for part in (result.where("fraction < 0.5"), result):
        model.save(part, database)
    found = spark.table(f"{database}.model_scaling_experiment").join(model.majority_shares(dealt), "fraction")
    return found.select(
        "fraction",
        "rows",
        "test_rows",
        "source_table",
        "note",
        "majority_share",
        F.least("accuracy", "majority_share").alias("reached"),
    )


# --- tables and streams -------------------------------------------------------


def _as_raw(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _raw_folders(spark, sf) -> str:
    """Write frames and detections (with copies) as raw folders."""
    base = scratch.folder(spark, "raw")
    parts = {"frames": derived.raw_frames(spark, sf), "ice_detections": derived.detections(spark, sf, copies=True)}
    for name, rows in parts.items():
        balanced = _as_raw(rows).hint("rebalance", F.col("dt"), F.col("cam_id"))
        balanced.write.partitionBy("dt", "cam_id").parquet(f"{base}/{name}")
    return base


def _etl(spark, sf) -> tuple[str, str]:
    base, database = _raw_folders(spark, sf), scratch.database(spark)
    etl.run(spark, f"{base}/frames", f"{base}/ice_detections", database, scratch.folder(spark, "warehouse"))
    return base, database


def etl_overwrite_roundtrip(spark, sf):
    """Load everything, then overwrite the second half of the month with a stricter threshold."""
    base, database = _etl(spark, sf)
    late = derived.detections(spark, sf, copies=True).where(F.col("dt") >= F.lit("2024-01-16").cast("date"))
    stricter = cleaning.clean_detections(_as_raw(late), threshold=0.5)
    tables.overwrite_partitions(stricter, f"{database}.detections")
    return (
        iso_date(spark.table(f"{database}.detections"), "dt")
        .groupBy("dt", "cam_id", "class_name")
        .agg(F.count(F.lit(1)).alias("detections"), F.sum("area_pixels").alias("area"))
    )


def table_counts(spark, sf):
    _, database = _etl(spark, sf)
    return tables.table_counts(spark, database)


def etl_hourly_table(spark, sf):
    _, database = _etl(spark, sf)
    hourly = spark.sql(f"SELECT * FROM {database}.hourly_summary").drop("dt")
    return snapped(
        hourly.withColumn("hour", F.col("hour").cast("timestamp_ntz")), "avg_ice_conc", "avg_severity"
    )


def incremental_refresh(spark, sf):
    """Three batches: frames of the first half, then their detections and more frames, then the rest.

    Detections come after the frames of their day. The content of all three tables ends up as after
    one full run.
    """
    base, whole, database = scratch.folder(spark, "raw"), _raw_folders(spark, sf), scratch.database(spark)
    folder, middle = scratch.folder(spark, "warehouse"), F.lit("2024-01-16").cast("date")

    def arrive(name: str, late: bool) -> None:
        rows = spark.read.parquet(f"{whole}/{name}")
        part = rows.where(F.col("dt") >= middle if late else F.col("dt") < middle)
        part.hint("rebalance", F.col("dt"), F.col("cam_id")).write.mode("append").partitionBy("dt", "cam_id").parquet(f"{base}/{name}")

    for step in ([("frames", False)], [("ice_detections", False), ("frames", True)], [("ice_detections", True)]):
        for name, late in step:
            arrive(name, late)
        etl.start_incremental(
            spark, f"{base}/frames", f"{base}/ice_detections", database, f"{base}/checkpoint", folder, count_vessel=True
        ).awaitTermination()

    def figures(part: str, table: str, day, rows, figure):
        by = spark.table(f"{database}.{table}").groupBy(F.date_format(day, "yyyy-MM-dd").alias("dt"), "cam_id")
        return by.agg(rows.alias("rows"), figure.cast("long").alias("figure")).select(F.lit(part).alias("part"), "dt", "cam_id", "rows", "figure")

    one = F.count(F.lit(1))
    return (
        figures("detections", "detections", F.col("dt"), one, F.sum("area_pixels"))
        .unionByName(figures("frames", "frames", F.col("dt"), one, F.sum("ice_field_area")))
        .unionByName(figures("hourly", "hourly_summary", F.col("hour"), F.sum("total_frames"), F.sum("vessel_frames")))
    )


def _message_folder(spark, sf) -> str:
    base = scratch.folder(spark, "stream")
    normaliser.write_messages(derived.timed_messages(spark, sf), f"{base}/in")
    return base


def stream_roundtrip(spark, sf):
    """Messages as text files through both streaming sinks; the frames that arrive."""
    base = _message_folder(spark, sf)
    source = normaliser.text_messages(spark, f"{base}/in")
    normaliser.drain(normaliser.start_two_queries(source, base, once=True))
    stored = spark.read.schema(schemas.RAW_FRAMES).parquet(f"{base}/raw/frames")
    return _flat_frames(stored)


def stream_detections(spark, sf):
    """The same messages read once for both sinks; the detections that arrive."""
    base = _message_folder(spark, sf)
    source = normaliser.text_messages(spark, f"{base}/in")
    normaliser.drain([normaliser.start_single_read(source, base, once=True)])
    return _wall(readers.raw_detections(spark, f"{base}/raw/ice_detections"))


def stream_latest(spark, sf):
    base = _message_folder(spark, sf)
    frames = messages.frames(messages.parse(normaliser.text_messages(spark, f"{base}/in"))).drop("pixels", "dt")
    query = stream_tables.latest_per_camera(frames, f"{base}/latest", f"{base}/latest_checkpoint", once=True)
    query.awaitTermination()
    newest = stream_tables.read_latest(spark, f"{base}/latest", frames.schema)
    return newest.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_hourly(spark, sf):
    """The hourly summary kept up to date by a stream: two halves of the month arrive, then nothing new."""
    base = scratch.folder(spark, "stream")
    sent, middle = derived.timed_messages(spark, sf), F.lit("2024-01-16").cast("date")
    for late in (False, True):
        day = F.to_date(F.timestamp_seconds("ts"))
        part = sent.where(day >= middle if late else day < middle)
        normaliser.write_messages(part, f"{base}/in")
        frames = messages.frames(messages.parse(normaliser.text_messages(spark, f"{base}/in")))
        stream_tables.hourly_summary(
            frames, f"{base}/hourly", f"{base}/checkpoint", count_vessel=True, once=True
        ).awaitTermination()
    hourly = stream_tables.read_hourly(spark, f"{base}/hourly")
    return snapped(hourly.withColumn("hour", F.col("hour").cast("timestamp_ntz")), "avg_ice_conc", "avg_severity")


def live_metrics_roundtrip(spark, sf):
    """Result entries as text fields, stored by date and read back."""
    base = scratch.folder(spark, "live")
    entries = derived.raw_frames(spark, sf).select(
        times.epoch_seconds(F.col("ts")).cast("decimal(20,6)").cast("string").alias("ts"),
        "cam_id",
        F.col("ice_conc").cast("string").alias("ice_conc"),
        F.col("ice_severity").cast("string").alias("ice_severity"),
        F.when(F.col("vessel_present"), "1").otherwise("0").alias("vessel_present"),
        F.to_json("pixels").alias("pixels_json"),
    )
    entries.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(entries.schema).parquet(f"{base}/in")
    stream_tables.live_metrics(stream, f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    stored = stream_tables.read_metrics(spark, f"{base}/out")
    pixels = stored.withColumn("pixels", messages.pixel_map(F.col("pixels_json")))
    return pixels.select(
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "cam_id",
        "ice_conc",
        "ice_severity",
        "vessel_present",
        F.col("pixels")["ice_field"].alias("ice_field"),
        F.col("pixels")["vessel"].alias("vessel"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        hourly_summary, hourly_vessels, danger_hours, class_distribution, area_percentiles, area_percentile_ranks,
        hour_of_day_profile, daily_summary, camera_means, camera_compare,
        camera_history, recent_stats, camera_status, waiting_alert, camera_rows, service_health,
        system_snapshot, recent_logs,
        messages_to_frames, messages_to_detections, clean_detections, clean_frames,
        tracked_detections, frame_totals,
        scene_kpis, scene_labels, frame_levels, metric_levels, queue_lag, parsed_times,
        field_trend, display_load, camera_cards, fleet_rollup, worst_camera, summary_note,
        latest_per_camera, last_n_points, trend_card, stored_last_points, stored_trend_card, stored_recent_stats, skip_repeats, frame_milestones,
        mask_histogram, region_bbox, mask_detections, solid_regions, median_split, zone_filter, zone_widened, box_rescale, box_mirror,
        fit_dimensions,
        class_camera_rollup, latency_summary, latency_from_csv, latency_distinct, joined_trials, trial_summary,
        speedup_pivot, linearity, shuffled_trials, synthetic_detections, synthetic_profile,
        training_rows, training_frames, danger_model_sweep,
        etl_overwrite_roundtrip, table_counts, etl_hourly_table, incremental_refresh,
        stream_roundtrip, stream_detections, stream_latest, stream_hourly, live_metrics_roundtrip,
    )
}
