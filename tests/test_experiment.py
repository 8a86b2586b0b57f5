"""Latency figures against the published summary, trial statistics, the model sweep."""

import pytest
from pyspark.sql import functions as F

from floeline import schemas, session
from floeline.operators import experiment, live, rollup
from floeline.plans import dashboard, model
from floeline.sources import derived, readers, synthetic

# Published trials and their published summary (fixed values).
TRIALS = """cam_id,frame_seq,source_ts,processed_ts,received_ts,worker_processing_ms,collector_delivery_ms,inference_ms,camera_count
bench_cam_1,4,1776762270.434759,1776762270.5295384,1776762270.531432,94.779,96.67301177978516,2.03,1
bench_cam_1,5,1776762271.43502,1776762271.496695,1776762271.4994774,61.675,64.45741653442383,1.643,1
bench_cam_1,6,1776762272.434157,1776762272.5123968,1776762272.515789,78.24,81.63213729858398,1.627,1
bench_cam_1,6,1776762272.434157,1776762272.5123968,1776762273.4925876,78.24,1058.4306716918945,1.627,1
bench_cam_1,6,1776762272.434157,1776762272.5123968,1776762274.507525,78.24,2073.3680725097656,1.627,1
bench_cam_2,3,1776762280.592203,1776762280.6680248,1776762280.6715488,75.822,79.3459415435791,2.457,2
bench_cam_2,4,1776762281.569227,1776762281.6471765,1776762281.6488483,77.95,79.6213150024414,5.059,2
bench_cam_2,5,1776762282.562287,1776762282.6251192,1776762282.625283,62.832,62.99591064453125,1.39,2
bench_cam_2,5,1776762282.562287,1776762282.6251192,1776762283.6487036,62.832,1086.416482925415,1.39,2
bench_cam_1,6,1776762283.563475,1776762283.6635287,1776762283.6658835,100.054,102.40864753723145,1.632,2
bench_cam_2,5,1776762282.562287,1776762282.6251192,1776762284.6240485,62.832,2061.7613792419434,1.39,2
bench_cam_1,6,1776762283.563475,1776762283.6635287,1776762284.627129,100.054,1063.6541843414307,1.632,2
bench_cam_1,6,1776762283.563475,1776762283.6635287,1776762285.6432946,100.054,2079.819679260254,1.632,2
bench_cam_2,5,1776762282.562287,1776762282.6251192,1776762285.6491115,62.832,3086.824417114258,1.39,2
"""
SUMMARY = {
    1: (5, 5, 0.0, 78.24, 91.4712, 96.67301177978516, 1870.3805923461912, 1.627, 1.9526, 0.8333333333333334),
    2: (12, 9, 0.25, 75.822, 100.054, 1063.6541843414307, 2684.022521972656, 1.632, 4.018199999999999, 1.5),
}
COLUMNS = (
    "published_measured", "processed_measured", "drop_rate", "end_to_end_median_ms", "end_to_end_p95_ms",
    "delivery_median_ms", "delivery_p95_ms", "inference_median_ms", "inference_p95_ms", "throughput_fps",
)


@pytest.fixture(scope="module")
def trials(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("trials") / "trials.csv"
    path.write_text(TRIALS)
    return readers.latency_trials(spark, str(path))


@pytest.fixture(scope="module")
def published(spark):
    return spark.createDataFrame(
        [(1, 5, 6.0), (2, 12, 6.0)], "camera_count int, published_measured long, window_sec double"
    )


def test_published_summary(trials, published):
    got = {r.camera_count: r for r in experiment.latency_summary(trials, published).collect()}
    assert set(got) == set(SUMMARY)
    for count, expected in SUMMARY.items():
        assert [got[count][c] for c in COLUMNS] == pytest.approx(list(expected), rel=1e-9)


def test_distinct_frames(trials, published):
    got = {r.camera_count: r for r in experiment.distinct_frames(trials, published).collect()}
    assert [(got[c].deliveries, got[c].distinct_frames) for c in (1, 2)] == [(5, 3), (9, 4)]
    assert [got[c].drop_rate for c in (1, 2)] == pytest.approx([0.4, 2 / 3])


def test_single_run_has_no_deviation(spark):
    df = spark.createDataFrame([(10, 1, 1, 2.0)], "rows long, executors int, trial int, time_s double")
    row = experiment.trial_summary(df).first()
    assert (row.runs, row.time_std_s, row.time_median_s) == (1, 0.0, 2.0)


def test_linearity(spark):
    rows = [(n, e, 3.0 * n if e == 1 else 5.0) for n in (1, 2, 4) for e in (1, 2)]
    df = spark.createDataFrame(rows, "rows long, executors int, time_median_s double")
    got = {r.executors: r for r in experiment.linearity(df).collect()}
    assert got[1].r2 == pytest.approx(1.0) and got[1].seconds_per_row == pytest.approx(3.0)
    assert got[2].r2 == 1.0
    assert [r.speedup_2 for r in experiment.speedup_pivot(df, [1, 2]).collect()] == pytest.approx([0.6, 1.2, 2.4])


def test_synthetic(spark):
    df = synthetic.detections(spark, 1000, 4)
    assert df.columns == ["cam_id", "confidence", "area_pixels", "ice_conc", "ice_severity", "dt", "class_name"]
    assert df.select("dt").distinct().count() > 20
    assert df.exceptAll(synthetic.detections(spark, 1000, 4)).isEmpty()
    assert df.where("confidence < 0.4 OR confidence >= 1.0 OR area_pixels NOT BETWEEN 100 AND 50099").isEmpty()
    assert experiment.class_camera_rollup(df).count() == 8


def test_shuffled_keeps_all(spark, small):
    rows = derived.scaling_trials(spark, small)
    mixed = experiment.shuffled(rows)
    assert mixed.drop("run_order_key").exceptAll(rows).isEmpty() and mixed.count() == rows.count()


def test_model_sources_and_sweep(spark, small):
    from floeline.operators import cleaning, reports

    hourly = reports.hourly_summary(derived.frames(spark, small))
    frames = cleaning.clean_frames(derived.raw_frames(spark, small))
    assert model.choose_rows("hourly_summary", hourly=hourly)[1] == model.HOURLY_FEATURES
    rows, features, source = model.choose_rows("frames", frames=frames)
    assert source == "frames" and features == model.FRAME_FEATURES
    for bad in ({"source": "frames", "frames": frames.limit(0)}, {"source": "frames", "hourly": hourly}, {"source": "other"}):
        with pytest.raises(ValueError):
            model.choose_rows(**bad)
    result = model.sweep(rows, features, source, fractions=(0.001, 0.5)).collect()
    assert [r.fraction for r in result] == [0.001, 0.5]
    assert result[0].accuracy is None and "training" in result[0].note
    assert result[1].note is None and 0.7 < result[1].accuracy <= 1.0
    assert 300 < result[1].rows + result[1].test_rows < 700


def test_fits_use_all_cores_whatever_the_files(spark, tmp_path, monkeypatch):
    """Training rows that come from one file are read by as many even tasks as there are cores, none lost."""
    one = spark.range(0, 4000, 1, 1).selectExpr("id", "id % 97 / 97 AS a", "id % 13 / 13 AS b", "if(id % 3 = 0, 'safe', 'danger') AS danger_level")
    one.write.parquet(str(tmp_path / "one"))
    seen = []
    monkeypatch.setattr(model, "_fitted", lambda dealt, features, fraction: seen.append(dealt) or (0.0, 1.0))
    rows = spark.read.parquet(str(tmp_path / "one"))
    assert rows.rdd.getNumPartitions() == 1
    model.sweep(rows, ["a", "b"], "made", fractions=(1.0,), key="id")
    (dealt,) = seen
    parts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) >= spark.sparkContext.defaultParallelism and max(parts) < 2 * min(parts)
    expected = model.bucketed(rows, "id").drop("id")
    assert sum(parts) == 4000 and dealt.exceptAll(expected).isEmpty()


def test_sweep_is_saved(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS sweeps LOCATION '{tmp_path}/sweeps'")
    row = spark.createDataFrame([(0.5, 80, 20, 1.5, 0.9, "frames", None)], schemas.SWEEP_RESULT)
    model.save(row, "sweeps")
    model.save(row, "sweeps")
    assert [tuple(r) for r in spark.table("sweeps.model_scaling_experiment").collect()] == [tuple(row.first())]
    spark.sql("DROP DATABASE sweeps CASCADE")


def test_shuffle_width():
    assert session.shuffle_width(0) == 200
    assert session.shuffle_width(100 * 1024**4) == 819_200
    assert session.shuffle_width(1000 * 128 * 1024**2 + 1) == 1001


def test_streaming_session_sets_the_state_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        made = session.streaming_session(state_partitions=2)
        assert made.conf.get("spark.sql.shuffle.partitions") == "2"
        assert made.conf.get("spark.sql.streaming.minBatchesToRetain") == "10"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fleet_without_data(spark):
    empty = spark.createDataFrame(
        [],
        "cam_id string, field_cover double, ice_cover double, loose_share double, display_load double, "
        "freshness double, frame_count long",
    )
    row = rollup.fleet_rollup(empty).first()
    assert tuple(row) == (0.0, 0.0, 0.0, 0.0, 0, 0, 0)


def test_ties_go_to_the_first_camera(spark):
    df = spark.createDataFrame([("cam_b", 0.5), ("cam_a", 0.5), ("cam_c", 0.1)], "cam_id string, display_load double")
    assert rollup.top_camera(df, "display_load").first().cam_id == "cam_a"


def test_camera_without_frames(spark, small):
    frames = derived.frames(spark, small)
    listed = live.camera_list(spark, ["cam_a", "cam_x"])
    cards = {r.cam_id: r for r in dashboard.camera_cards(frames, live.newest(frames), listed).collect()}
    idle = cards["cam_x"]
    assert (idle.scene_kind, idle.freshness, idle.display_load, idle.frame_count) == ("open_water", 1.0, 0.0, 0)
    assert idle.vessel_present is False and cards["cam_a"].trend_points == 12


def test_unknown_camera_has_no_history(spark, small):
    metrics = derived.frames(spark, small)
    assert live.history(metrics, "cam_x").isEmpty()
    assert live.history(metrics, "cam_a", limit=7).count() == 7


def test_waiting_alert(spark):
    ddl = "cam_id string, has_results boolean"
    cases = {True: [("a", False), ("b", False)], False: [("a", False), ("b", True)]}
    for expected, rows in cases.items():
        assert live.waiting_for_results(spark.createDataFrame(rows, ddl)).first().waiting is expected
    assert live.waiting_for_results(spark.createDataFrame([], ddl)).first().waiting is False


def test_live_window_with_the_clock(spark):
    df = spark.range(1).select(
        F.lit("cam_a").alias("cam_id"), F.current_timestamp().alias("ts"), F.lit(0.5).alias("ice_conc"),
        F.lit(0.1).alias("ice_severity"),
    )
    assert live.recent_stats(df).first().cnt == 1
    old = df.withColumn("ts", F.col("ts") - F.expr("INTERVAL 2 HOURS"))
    assert live.recent_stats(old).isEmpty()


def test_features_are_parsed_once(spark, small):
    from floeline.plans import registry

    plan = registry.training_frames(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("get_json_object") <= 2, plan.count("get_json_object")
