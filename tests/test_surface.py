"""Pixel operators against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from floeline.operators import cleaning, surface, zones


def test_histogram_and_boxes(spark):
    grid = np.zeros((4, 5), dtype=int)
    grid[1, 2:4] = 1
    grid[3, 0] = 3
    grid[0, 0] = 4
    df = spark.createDataFrame([(1, grid.ravel().tolist()), (2, [0] * 20)], "frame_id long, mask array<int>")
    counts = {r.frame_id: r for r in surface.mask_histogram(df).collect()}
    first = counts[1]
    assert (first.ice_field_pixels, first.slush_ice_pixels, first.vessel_pixels, first.usable_pixels) == (2, 1, 1, 19)
    assert counts[2].usable_pixels == 20
    boxes = {
        (r.frame_id, r.class_name): (r.bbox_x1, r.bbox_y1, r.bbox_x2, r.bbox_y2, r.area_pixels)
        for r in surface.region_boxes(df, ["frame_id"], 5).collect()
    }
    assert boxes == {(1, "ice_field"): (2, 1, 3, 1, 2), (1, "slush_ice"): (0, 3, 0, 3, 1)}


def brute_split(pixels, cam, width, height, least):
    top, bottom = int(height * 0.18), int(height * 0.97)
    kept = [
        (i % width, b - 0.18 * s)
        for i, (v, s, b) in enumerate(pixels)
        if v > 72 and s < 190 and top <= i // width < bottom
    ]
    if not kept:
        return ("none", 0, 0)
    scores = np.array([s for _, s in kept])
    enough = max(least, int(width * height * 0.01)) // 4
    cut = np.median(scores)
    rule, ice, slush = "median", (scores <= cut).sum(), (scores > cut).sum()
    if ice < enough or slush < enough:
        low, high = np.percentile(scores, [40, 60])
        rule, ice, slush = "tails", (scores <= low).sum(), (scores >= high).sum()
        if ice < enough and slush < enough:
            left = int(width * 0.56) if cam == "cam_a" else int(width * 0.44)
            side = [x < left if cam == "cam_a" else x > left for x, _ in kept]
            rule, ice, slush = "columns", sum(side), len(kept) - sum(side)
    return (rule, int(ice), int(slush))


def test_median_split(spark):
    rng = np.random.default_rng(3)
    frames = []
    for i in range(60):
        spread = (1, 4, 256)[i % 3]  # few distinct values make the median lopsided
        frames.append(
            [(int(v), int(s), int(b)) for v, s, b in zip(rng.integers(0, 256, 64), [20] * 64, rng.integers(0, spread, 64))]
        )
    frames.append([(0, 0, 0)] * 64)
    rows = [(i, "cam_a" if i % 2 else "cam_b", f) for i, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "id long, cam_id string, pixels array<struct<value:long,saturation:long,b:long>>")
    seen = set()
    for least in (8, 60, 200):
        got = surface.median_split(df, ["id"], 8, 8, least_pixels=least).collect()
        assert len(got) == len(rows)
        for r in got:
            expected = brute_split(frames[r.id], rows[r.id][1], 8, 8, least)
            assert (r.rule, r.ice_pixels, r.slush_pixels) == expected
            seen.add(r.rule)
    assert seen == {"none", "median", "tails", "columns"}


def test_zone(spark):
    points = spark.createDataFrame(
        [("cam_a", 0.9, 0.5), ("cam_a", 0.1, 0.5), ("cam_b", 0.1, 0.5), ("cam_b", 0.9, 0.5), ("cam_x", 0.5, 0.5)],
        "cam_id string, x double, y double",
    )
    marked = zones.mark_zone(points, zones.zone_edges(spark)).collect()
    assert {(r.cam_id, r.x, r.in_zone) for r in marked} == {
        ("cam_a", 0.9, True), ("cam_a", 0.1, False), ("cam_b", 0.1, True), ("cam_b", 0.9, False), ("cam_x", 0.5, False),
    }


def test_tracked(spark):
    df = spark.range(8).select(F.col("id").cast("int").alias("class_id"))
    got = {r.class_id: r.class_name for r in cleaning.tracked_only(df).collect()}
    assert got == {0: "slush_ice", 2: "broken_ice", 3: "vessel", 4: "ice_field"}
