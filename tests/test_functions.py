"""Column expressions at their edges."""

from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from floeline import schemas
from floeline.functions import geometry, levels, masks, numbers, scoring, times


def values(spark, rows, ddl, **columns):
    df = spark.createDataFrame(rows, ddl)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def near(edge):
    return [edge - 1e-9, edge, edge + 1e-9]


@pytest.mark.parametrize(
    "edge, below, at, above",
    [(0.7, "caution", "caution", "danger"), (0.4, "safe", "safe", "caution")],
)
def test_hourly_level_is_strict(spark, edge, below, at, above):
    got = values(spark, [(v,) for v in near(edge)], "v double", r=levels.hourly_level(F.col("v")))
    assert [g[0] for g in got] == [below, at, above]


def test_hourly_level_of_null_is_safe(spark):
    assert one(spark, levels.hourly_level(F.lit(None).cast("double"))) == "safe"


@pytest.mark.parametrize(
    "conc, sev, expected",
    [
        (0.7, 0.0, "caution"), (0.7000001, 0.0, "danger"), (0.0, 0.55, "caution"), (0.0, 0.5500001, "danger"),
        (0.4, 0.3, "safe"), (0.4000001, 0.0, "caution"), (0.0, 0.3000001, "caution"), (0.0, 0.0, "safe"),
    ],
)
def test_frame_level(spark, conc, sev, expected):
    assert one(spark, levels.frame_level(F.lit(conc), F.lit(sev))) == expected


@pytest.mark.parametrize(
    "field, load, expected",
    [
        (0.35, 0.0, "danger"), (0.3499999, 0.0, "caution"), (0.0, 0.45, "danger"), (0.0, 0.4499999, "caution"),
        (0.16, 0.0, "caution"), (0.1599999, 0.0, "ok"), (0.0, 0.20, "caution"), (0.0, 0.1999999, "ok"),
    ],
)
def test_scene_level_includes_thresholds(spark, field, load, expected):
    assert one(spark, levels.scene_level(F.lit(field), F.lit(load))) == expected


@pytest.mark.parametrize(
    "level, caution, danger",
    [(levels.field_level, 0.16, 0.35), (levels.ice_level, 0.30, 0.60), (levels.loose_level, 0.35, 0.65)],
)
def test_metric_levels(spark, level, caution, danger):
    got = values(spark, [(v,) for v in near(caution) + near(danger)], "v double", r=level(F.col("v")))
    assert [g[0] for g in got] == ["ok", "caution", "caution", "caution", "danger", "danger"]


@pytest.mark.parametrize(
    "ice, field, pressure, loose, expected",
    [
        (0, 0.9, 0.9, 0.9, "open_water"), (1, 0.35, 0.0, 0.0, "dense_field"), (1, 0.0, 0.45, 0.0, "dense_field"),
        (1, 0.16, 0.0, 0.9, "mixed_ice"), (1, 0.1, 0.1, 0.65, "loose_ice"), (1, 0.1, 0.1, 0.64, "sparse_ice"),
    ],
)
def test_scene_kind(spark, ice, field, pressure, loose, expected):
    got = one(spark, levels.scene_kind(F.lit(ice), F.lit(field), F.lit(pressure), F.lit(loose)))
    assert got == expected and got in schemas.SCENE_LABELS


@pytest.mark.parametrize(
    "areas, expected",
    [
        ((5, 5, 5), "ice_field"), ((4, 5, 5), "broken_ice"), ((1, 2, 3), "slush_ice"), ((0, 0, 0), "open_water"),
        ((5, 1, 5), "ice_field"),
    ],
)
def test_largest_class_prefers_the_earlier(spark, areas, expected):
    assert one(spark, levels.largest_class(*[F.lit(a) for a in areas])) == expected


@pytest.mark.parametrize(
    "field, loose, expected",
    [(0.35, 0.9, "solid_field"), (0.0799, 0.65, "loose_only"), (0.08, 0.9, "peak_zone"), (0.05, 0.64, "peak_zone")],
)
def test_note_code(spark, field, loose, expected):
    assert one(spark, levels.note_code(F.lit(field), F.lit(loose))) == expected


def test_scores(spark):
    lit = F.lit
    assert one(spark, scoring.concentration(lit(60), lit(30), lit(30), lit(100), lit(200))) == pytest.approx(1.2)
    assert one(spark, scoring.concentration(lit(5), lit(0), lit(0), lit(300), lit(200))) == 5.0
    assert one(spark, scoring.severity(lit(0), lit(0), lit(0))) == 0.0
    assert one(spark, scoring.severity(lit(0), lit(50), lit(50))) == pytest.approx(0.75)


@settings(max_examples=1, deadline=None)
@given(
    st.lists(
        st.tuples(*[st.integers(0, 1_000_000) for _ in range(4)]), min_size=300, max_size=300
    )
)
def test_scene_metrics_hold_for_any_areas(spark, rows):
    ddl = "ice_field int, broken_ice int, slush_ice int, vessel int"
    df = spark.createDataFrame(rows + [(0, 0, 0, 0)], ddl).withColumn("total_pixels", F.lit(1_000_000))
    for r in scoring.scene_metrics(df).collect():
        shares = r.field_share + r.broken_share + r.slush_share
        assert shares == pytest.approx(1.0 if r.ice_pixels else 0.0)
        assert 0 <= r.roughness <= 1 and 0 <= r.scene_pressure <= 1
        assert r.loose_share == pytest.approx(r.broken_share + r.slush_share)


def test_display_load_stays_in_range(spark):
    rows = [(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0), (5.0, 1.0, 1.0, 1.0), (0.5, 0.5, 0.5, 0.0)]
    column = scoring.display_load(*[F.col(c) for c in "abcd"])
    got = [v[0] for v in values(spark, rows, "a double, b double, c double, d double", r=column)]
    assert got == pytest.approx([0.0, 1.0, 1.0, 0.45])


def test_rounding(spark):
    rows = [(0.5,), (1.5,), (2.5,), (2.6,)]
    assert [v[0] for v in values(spark, rows, "v double", r=numbers.half_even(F.col("v")))] == [0, 2, 2, 3]
    assert one(spark, numbers.half_up(F.lit(0.12345), 4)) == 0.1235
    noisy = [(0.7005 - 1e-16,), (0.7005,), (0.7005 + 1e-16,)]
    assert {v[0] for v in values(spark, noisy, "v double", r=numbers.settled(F.col("v"), 3))} == {0.701}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1700000000", datetime(2023, 11, 14, 22, 13, 20)),
        ("1700000000.5", datetime(2023, 11, 14, 22, 13, 20, 500000)),
        ("0", datetime(1970, 1, 1)),
        (" 2024-01-05T10:00:00Z ", datetime(2024, 1, 5, 10)),
        ("2024-01-05T10:00:00+03:00", datetime(2024, 1, 5, 7)),
        ("2024-01-05", datetime(2024, 1, 5)),
        ("", None), (None, None), ("-5", None), ("soon", None), ("2024-13-05T10:00:00Z", None),
    ],
)
def test_parse_text_time(spark, text, expected):
    assert one(spark, times.parse_text_time(F.lit(text).cast("string"))) == expected


def test_parse_epoch_and_wall_clock(spark):
    assert one(spark, times.parse_epoch(F.lit(0))) is None
    assert one(spark, times.parse_epoch(F.lit(1.5))) == datetime(1970, 1, 1, 0, 0, 1, 500000)
    assert one(spark, times.wall_clock(times.parse_epoch(F.lit(1_700_000_000)))) == "01:13:20"
    assert one(spark, times.wall_clock(times.parse_epoch(F.lit(0)))) == "нет"


def test_event_time_grain(spark):
    epoch = F.lit(1776762270.434759)
    assert one(spark, times.event_time(epoch)).microsecond == 434759
    assert one(spark, times.event_time(epoch, "second")).microsecond == 0
    assert one(spark, times.event_time(F.lit(1e300))) is None
    with pytest.raises(ValueError):
        times.event_time(epoch, "hour")


def test_ages(spark):
    early, late = F.lit(datetime(2024, 1, 1)), F.lit(datetime(2024, 1, 1, 0, 0, 8))
    assert one(spark, times.lag_seconds(late, early)) == 8.0
    assert one(spark, times.lag_seconds(early, late)) == 0.0
    assert one(spark, times.lag_seconds(late, F.lit(None).cast("timestamp"))) is None
    assert one(spark, times.freshness(F.lit(8.0))) == 0.5
    assert one(spark, times.freshness(F.lit(None).cast("double"))) == 1.0
    assert one(spark, times.mask_is_fresh(F.lit(8.0))) is True
    assert one(spark, times.mask_is_fresh(F.lit(8.01))) is False
    assert one(spark, times.mask_is_fresh(F.lit(None).cast("double"))) is False
    assert one(spark, times.queue_age_ms(F.lit(2.5), F.lit(None).cast("double"))) is None
    assert one(spark, times.mask_lag_sec(F.lit(1.0), F.lit(3.0))) == 0.0


def test_mirror(spark):
    rows = [(10, 0, 30, 5), (90, 0, 130, 5), (None, 0, 30, 5)]
    x1, x2 = geometry.mirror_box(*[F.col(c) for c in ("a", "b", "c", "d")], F.lit(100))
    got = values(spark, rows, "a int, b int, c int, d int", x1=x1, x2=x2)
    assert got == [(70, 90), (0, 10), (None, 30)]


def test_fit(spark):
    def longest(w, h, limit):
        return values(spark, [(w, h)], "w int, h int", **dict(zip("ab", geometry.fit_longest_side(F.col("w"), F.col("h"), limit))))[0]

    assert longest(1920, 1080, 512) == (512, 288)
    assert longest(300, 200, 512) == (300, 200)
    assert longest(5000, 1, 512) == (512, 1)
    assert longest(5000, 10, 0) == (5000, 10)
    shown = values(spark, [(1920, 1080), (100, 100)], "w int, h int", **dict(zip("ab", geometry.fit_box(F.col("w"), F.col("h"), 680, 382))))
    assert shown == [(679, 382), (100, 100)]


def test_rescale(spark):
    size = [F.lit(v) for v in (512, 288, 1920, 1080)]
    assert one(spark, geometry.rescale_area(F.lit(8), *size)) == 112  # 112.5 goes to the even side
    assert one(spark, geometry.rescale_edge(F.lit(2), F.lit(512), F.lit(1920))) == 8  # 7.5


def test_inside(spark):
    edges = F.array(
        *[
            F.struct(F.lit(a).alias("x1"), F.lit(b).alias("y1"), F.lit(c).alias("x2"), F.lit(d).alias("y2"))
            for a, b, c, d in ((0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0))
        ]
    )
    rows = [(0.5, 0.5), (1.5, 0.5), (-0.1, 0.5), (0.5, 2.0)]
    got = values(spark, rows, "x double, y double", r=geometry.inside(F.col("x"), F.col("y"), edges))
    assert [g[0] for g in got] == [True, False, False, False]
    none = F.lit(None).cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    assert one(spark, geometry.inside(F.lit(0.5), F.lit(0.5), none)) is False


def test_sorted_quantile(spark):
    ordered = F.array(*[F.lit(v) for v in (1.0, 2.0, 4.0, 8.0)])
    assert one(spark, masks.sorted_quantile(ordered, 0.5)) == 3.0
    assert one(spark, masks.sorted_quantile(ordered, 1.0)) == 8.0
