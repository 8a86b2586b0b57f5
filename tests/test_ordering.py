"""Ordered operators against plain windows and numpy, with one crowded key and tiny blocks."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from floeline.operators import ordering, quantiles, trend

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """4000 rows of `hot`, 40 of `cold`, 3 of a NULL key; ids are unique, some times are not."""
    rows = [("hot", START + timedelta(seconds=i // 3), i, ((i * 37) % 101) / 50 - 0.5) for i in range(4000)]
    rows += [("cold", START + timedelta(hours=i), 10_000 + i, i / 40) for i in range(40)]
    rows += [(None, START + timedelta(hours=i), 20_000 + i, 0.5) for i in range(3)]
    return spark.createDataFrame(rows, "cam_id string, ts timestamp, id long, v double").repartition(7).persist()


def window():
    return Window.partitionBy("cam_id").orderBy("ts", "id")


def same(left, right):
    assert left.count() == right.count()
    assert left.exceptAll(right).isEmpty()


def test_number_rows(series):
    got = ordering.number_rows(series, ["cam_id"], ["ts", "id"])
    expected = series.withColumn("position", F.row_number().over(window()) - 1).withColumn(
        "key_rows", F.count(F.lit(1)).over(Window.partitionBy("cam_id"))
    )
    same(got.select("id", "position", "key_rows"), expected.select("id", "position", "key_rows"))


@pytest.mark.parametrize("rows,parts", [(4000, 1), (4000, 9), (150, 40)])
def test_smoothed_does_not_depend_on_partitions(series, rows, parts):
    """Down to partitions of fewer rows than are looked back at."""
    some = series.where(F.col("id").between(0, rows - 1) | (F.col("id") >= 10_000))
    got = trend.smoothed(some, "v", ["cam_id"], ["ts", "id"], parts=parts)
    clamped = F.greatest(F.lit(0.0), F.least(F.col("v"), F.lit(1.0)))
    last = F.collect_list(clamped).over(window().rowsBetween(-11, 0))
    expected = some.withColumn("trend", trend.smooth_array(last))
    assert got.columns == [*series.columns, "trend"]
    same(got.select("id", "trend"), expected.select("id", "trend"))


def test_smoothed_shuffles_the_rows_once(series):
    """What is left after the rows are written: windows inside buckets and one small joined side."""
    plan = trend.smoothed(series, "v", ["cam_id"], ["ts", "id"])._jdf.queryExecution().executedPlan().toString()
    windowed, _, handed = plan.partition("BroadcastExchange")
    assert "SelectedBucketsCount" in windowed and "Window" in windowed and "Exchange hashpartitioning" not in windowed
    assert "edges" in handed


def test_windowed_counts_earlier_rows(series):
    def columns(before, rows):
        return {"rows": rows, "third": before("id", 3)}

    got = ordering.windowed(series, ["cam_id"], ["ts", "id"], 3, ["id"], columns, parts=30)
    expected = series.withColumns(
        {"rows": F.least(F.row_number().over(window()) - 1, F.lit(3)), "third": F.lag("id", 3).over(window())}
    )
    same(got.select("id", "rows", "third"), expected.select("id", "rows", "third"))


def test_windowed_of_nothing(series):
    empty = series.where("id < 0")
    assert trend.smoothed(empty, "v", ["cam_id"], ["ts", "id"]).count() == 0
    with pytest.raises(ValueError):
        ordering.windowed(series, ["cam_id"], ["ts", "id"], 0, ["id"], lambda before, rows: {})


@pytest.mark.parametrize("n", [1, 60, 5000])
def test_last_n(series, n):
    order = Window.partitionBy("cam_id").orderBy(F.desc("ts"), F.desc("id"))
    expected = series.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    same(ordering.last_n(series, ["cam_id"], ["ts", "id"], n), expected)


def test_last_n_keeps_rows_without_time(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", START, 2)], "cam_id string, ts timestamp, id long")
    got = ordering.last_n(df, ["cam_id"], ["ts", "id"], 5).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 1]


def test_latest(series):
    got = {r.cam_id: r.id for r in trend.latest(series, ["cam_id"], ["ts", "id"]).collect()}
    assert got == {"hot": 3999, "cold": 10_039, None: 20_002}


@pytest.mark.parametrize("interpolate", [True, False])
def test_exact_quantiles(series, interpolate):
    probs = {"lowest": 0.0, "p05": 0.05, "median": 0.5, "p95": 0.95, "highest": 1.0}
    got = quantiles.exact_quantiles(series, ["cam_id"], "v", probs, interpolate).collect()
    by_cam = {}
    for r in series.collect():
        by_cam.setdefault(r.cam_id, []).append(r.v)
    assert {r.cam_id for r in got} == set(by_cam)
    for r in got:
        data = by_cam[r.cam_id]
        assert r.n == len(data)
        for name, p in probs.items():
            method = "linear" if interpolate else "inverted_cdf"
            assert r[name] == pytest.approx(np.quantile(data, p, method=method), abs=1e-12), (r.cam_id, name)


def test_exact_quantiles_of_copies_and_nulls(spark):
    rows = [("a", 5)] * 1000 + [("a", 9)] + [("a", None)] * 500 + [("b", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = quantiles.exact_quantiles(df, ["k"], "v", {"median": 0.5, "top": 1.0}, interpolate=False).collect()
    assert [tuple(r) for r in got] == [("a", 1001, 5, 9)]


def test_skip_repeats(spark):
    ids = ["x", "x", "y", None, None, "x", "x", "x", "z"]
    rows = [("a", i, v) for i, v in enumerate(ids)]
    df = spark.createDataFrame(rows, "cam_id string, ts long, msg string")
    for parts in (1, 20):
        got = trend.skip_repeats(df, ["cam_id"], ["ts"], "msg", parts=parts).orderBy("ts").collect()
        assert [r.ts for r in got] == [0, 2, 3, 5, 8]


def test_first_row_with_null_id_is_kept(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "cam_id string, ts long, msg string")
    assert [r.ts for r in trend.skip_repeats(df, ["cam_id"], ["ts"], "msg").collect()] == [1]


def test_milestones(series):
    got = trend.milestones(series, ["cam_id"], ["ts", "id"], 20)
    assert {(r.cam_id, r.n) for r in got.groupBy("cam_id").agg(F.count("*").alias("n")).collect()} == {
        ("hot", 200), ("cold", 2)
    }


def test_trend_card(spark):
    df = spark.createDataFrame([("a", i, i / 10) for i in range(15)], "cam_id string, ts long, v double")
    df = df.withColumn("ts", F.timestamp_seconds("ts"))
    card = trend.trend_card(df, "v", ["cam_id"], ["ts"], points=4).first()
    assert (card.current_value, card.peak_value, card.points) == (1.0, 1.0, 4)


def test_smooth_array_of_nothing(spark):
    empty = F.array().cast("array<double>")
    assert spark.range(1).select(trend.smooth_array(empty).alias("v")).first().v == 0.0


def test_no_task_gets_a_whole_key(series):
    """The hot key is spread over several range partitions before it is numbered."""
    placed = ordering._place(series, ["cam_id"], ["ts", "id"])
    ordered = placed.where("cam_id = 'hot'").orderBy("ts", "id").select("_row").collect()
    rows = [r._row for r in ordered]
    assert rows == sorted(rows)


def test_last_of_many_is_limited_before_the_shuffle(spark):
    rows = [(i % 7, i, i * 31 % 50) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, ts int, id int")
    many = ordering.last_n_of_many(df, ["k"], ["ts", "id"], 3)
    got = {(r.k, r.ts, r["rank"]) for r in many.collect()}
    assert got == {(k, t, n + 1) for k in range(7) for n, t in enumerate(sorted((i for i in range(300) if i % 7 == k), reverse=True)[:3])}
    assert "WindowGroupLimit" in many._jdf.queryExecution().executedPlan().toString()
