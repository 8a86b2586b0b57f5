"""Readers, cleaning, the ETL and its tables."""

import uuid
from datetime import date, datetime

import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.sql import functions as F

from floeline import schemas
from floeline.operators import cleaning, live, reports
from floeline.plans import etl
from floeline.sources import derived, readers, scratch, tables


@pytest.fixture
def database(spark, tmp_path):
    name = f"test_{uuid.uuid4().hex[:10]}"
    tables.create_tables(spark, name, str(tmp_path / "warehouse"))
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def frame(day, cam, conc, vessel=False, hour=1):
    pixels = {"vessel": 1 if vessel else 0, "ice_field": 2, "broken_ice": 3, "slush_ice": 4}
    return (datetime(2024, 1, day, hour), cam, conc, 0.1, vessel, pixels, date(2024, 1, day))


def found(day, cam, conf, x1=0, area=5, name="ice_field"):
    return (datetime(2024, 1, day, 1), cam, name, conf, area, x1, 0, 9, 9, 0.5, 0.1, date(2024, 1, day))


def frames_df(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RAW_FRAMES)


def found_df(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RAW_DETECTIONS)


def test_missing_folder_is_an_empty_frame(spark, tmp_path):
    df = readers.raw_frames(spark, str(tmp_path / "nowhere"))
    assert df.schema == schemas.RAW_FRAMES and df.isEmpty()


def test_other_read_errors_are_raised(spark):
    with pytest.raises(IllegalArgumentException):
        readers.parquet_or_empty(spark, "", schemas.RAW_FRAMES).count()


def test_partition_columns_keep_their_types(spark, tmp_path):
    path = str(tmp_path / "raw")
    frames_df(spark, frame(1, "007", 0.5)).write.partitionBy("dt", "cam_id").parquet(path)
    row = readers.raw_frames(spark, path).first()
    assert row.cam_id == "007" and row.dt == date(2024, 1, 1)


def test_confidence_and_duplicates(spark):
    raw = found_df(
        spark, found(1, "a", 0.3), found(1, "a", None), found(1, "a", 0.5, area=1), found(1, "a", 0.9, area=2),
        found(1, "a", 0.9, area=3), found(1, "a", 0.4, x1=7), found(1, "b", 0.31),
    )
    kept = cleaning.clean_detections(raw)
    got = {(r.cam_id, r.bbox_x1, r.confidence, r.area_pixels) for r in kept.collect()}
    assert got == {("a", 0, 0.9, 3), ("a", 7, 0.4, 5), ("b", 0, 0.31, 5)}
    assert kept.columns[-2:] == ["dt", "cam_id"]
    again = cleaning.drop_duplicates(kept)
    assert again.exceptAll(kept).isEmpty() and again.count() == 3


def test_date_filter_reaches_the_scan_below_dedup(spark, tmp_path):
    path = str(tmp_path / "raw")
    found_df(spark, found(1, "a", 0.9), found(2, "a", 0.9)).write.partitionBy("dt", "cam_id").parquet(path)
    kept = cleaning.clean_detections(readers.raw_detections(spark, path)).where("dt = DATE'2024-01-02'")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "GreaterThan(confidence,0.3)" in plan
    assert kept.count() == 1


def test_trailing_window_prunes_dates(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [frame(day, "a", 0.5, hour=h) for day in (1, 2, 3) for h in (0, 23)]
    frames_df(spark, *rows).write.partitionBy("dt", "cam_id").parquet(path)
    frames = readers.raw_frames(spark, path)
    stats = live.recent_stats(frames, F.lit(datetime(2024, 1, 3, 0, 30)), hours=2)
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "(dt" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert stats.first().cnt == 3


def test_overwrite_leaves_other_partitions(spark, database):
    table = f"{database}.frames"
    first = cleaning.clean_frames(frames_df(spark, frame(1, "a", 0.1), frame(2, "a", 0.2), frame(2, "b", 0.3)))
    tables.overwrite_partitions(first, table)
    tables.overwrite_partitions(cleaning.clean_frames(frames_df(spark, frame(2, "a", 0.9))), table)
    got = {(str(r.dt), r.cam_id, r.ice_conc) for r in spark.table(table).collect()}
    assert got == {("2024-01-01", "a", 0.1), ("2024-01-02", "a", 0.9), ("2024-01-02", "b", 0.3)}


def test_etl_guards(spark, tmp_path, database):
    nothing = etl.run(spark, str(tmp_path / "f"), str(tmp_path / "d"), database)
    assert nothing == etl.EtlRun(ran=False)
    frames_df(spark, frame(1, "a", 0.8)).write.partitionBy("dt", "cam_id").parquet(str(tmp_path / "f"))
    found_df(spark, found(1, "a", 0.2)).write.partitionBy("dt", "cam_id").parquet(str(tmp_path / "d"))
    assert etl.run(spark, str(tmp_path / "f"), str(tmp_path / "d"), database) == etl.EtlRun(True, False)
    counts = {r.table_name: r.rows for r in tables.table_counts(spark, database).collect()}
    assert counts == {"detections": 0, "frames": 1, "hourly_summary": 1}


def test_etl_twice_changes_nothing(spark, small, tmp_path, database):
    def raw(df):
        return df.withColumn("ts", F.col("ts").cast("timestamp"))

    frames, found_rows = raw(derived.raw_frames(spark, small)), raw(derived.detections(spark, small, copies=True))
    for _ in range(2):
        etl.load(frames, found_rows, database)
        counts = {r.table_name: r.rows for r in tables.table_counts(spark, database).collect()}
        assert counts["frames"] == 1000
    levels = spark.sql(f"SELECT danger_level, count(*) AS n FROM {database}.hourly_summary GROUP BY 1")
    assert {r.danger_level for r in levels.collect()} == {"safe", "caution", "danger"}


def test_incremental_run_rewrites_only_touched_partitions(spark, tmp_path, database):
    frames, found_path, checkpoint = (str(tmp_path / n) for n in ("f", "d", "c"))

    def append(*rows):
        frames_df(spark, *rows).write.mode("append").partitionBy("dt", "cam_id").parquet(frames)

    def follow():
        etl.start_incremental(spark, frames, found_path, database, checkpoint).awaitTermination()
        rows = spark.table(f"{database}.hourly_summary").collect()
        return {(r.hour.day, r.hour.hour, r.cam_id): r.total_frames for r in rows}

    append(frame(1, "a", 0.1), frame(2, "a", 0.2))
    assert follow() == {(1, 1, "a"): 1, (2, 1, "a"): 1}
    # a row only the table knows: it survives while its partition is not touched
    tables.overwrite_partitions(cleaning.clean_frames(frames_df(spark, frame(1, "a", 0.7))), f"{database}.frames")
    append(frame(2, "a", 0.4), frame(2, "a", 0.4, hour=5), frame(3, "b", 0.5))
    assert follow() == {(1, 1, "a"): 1, (2, 1, "a"): 2, (2, 5, "a"): 1, (3, 1, "b"): 1}
    assert spark.table(f"{database}.frames").where("dt = DATE'2024-01-01'").first().ice_conc == 0.7
    assert follow() == {(1, 1, "a"): 1, (2, 1, "a"): 2, (2, 5, "a"): 1, (3, 1, "b"): 1}


def test_late_detections_and_options(spark, tmp_path, database):
    frames, found_path, checkpoint = (str(tmp_path / n) for n in ("f", "d", "c"))

    def follow():
        etl.start_incremental(spark, frames, found_path, database, checkpoint, count_vessel=True).awaitTermination()
        counts = {r.table_name: r.rows for r in tables.table_counts(spark, database).collect()}
        vessels = {(r.hour.day, r.cam_id): r.vessel_frames for r in spark.table(f"{database}.hourly_summary").collect()}
        return counts["frames"], counts["detections"], vessels

    def add(df, path):
        df.write.mode("append").partitionBy("dt", "cam_id").parquet(path)

    add(frames_df(spark, frame(1, "a", 0.5, vessel=True), frame(1, "b", 0.5)), frames)
    assert follow() == (2, 0, {(1, "a"): 1, (1, "b"): 0})
    add(found_df(spark, found(1, "a", 0.9)), found_path)
    assert follow() == (2, 1, {(1, "a"): 1, (1, "b"): 0})
    add(frames_df(spark, frame(2, "b", 0.5, vessel=True)), frames)
    assert follow() == (3, 1, {(1, "a"): 1, (1, "b"): 0, (2, "b"): 1})


def test_only_prunes_while_it_runs(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [frame(day, cam, 0.1) for day in (1, 2, 3) for cam in ("a", "b")]
    odd = (None, None, 0.1, 0.1, False, {}, None)
    frames_df(spark, *rows, odd).write.partitionBy("dt", "cam_id").parquet(path)
    df = readers.raw_frames(spark, path)
    keys_path = str(tmp_path / "keys")
    df.where("dt is null or (day(dt) < 3 and cam_id = 'a')").select("dt", "cam_id").write.parquet(keys_path)
    kept = etl.only(df, spark.read.schema("dt date, cam_id string").parquet(keys_path))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert sorted((str(r.dt), str(r.cam_id)) for r in kept.collect()) == [("2024-01-01", "a"), ("2024-01-02", "a"), ("None", "None")]


def test_hourly_summary_options(spark):
    df = frames_df(spark, frame(1, "a", None, vessel=True), frame(1, "a", None))
    plain, counted = reports.hourly_summary(df).first(), reports.hourly_summary(df, count_vessel=True).first()
    assert (plain.vessel_frames, counted.vessel_frames) == (0, 1)
    assert plain.danger_level == "safe" and plain.total_frames == 2


def test_approximate_percentiles_are_close(spark, small):
    rows = derived.detections(spark, small)
    exact = {r.class_name: r for r in reports.area_percentiles(rows).collect()}
    for r in reports.area_percentiles_approx(rows).collect():
        for name in ("p25", "median", "p75", "p95", "max_area"):
            assert r[name] == pytest.approx(exact[r.class_name][name], abs=2000)


def test_scratch_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch.folder(spark, "x").startswith(f"{shared}/floeline/x-")
    staged = scratch.stage(spark.range(5), "numbers")
    assert staged.count() == 5


def test_frame_totals_add_overlaps(spark):
    rows = [(1, "ice_field", 700, 1000), (1, "ice_field", 500, 1000), (1, "vessel", 200, 1000), (2, "vessel", 5, 1000)]
    df = spark.createDataFrame(rows, "frame_id long, class_name string, area_pixels int, total_pixels int")
    got = {r.frame_id: r for r in cleaning.frame_totals(df, ["frame_id"]).collect()}
    assert got[1].ice_field == 1200 and got[1].ice_conc == 1.5 and got[1].vessel_present
    assert got[2].ice_conc == 0.0 and got[2].ice_severity == 0.0
