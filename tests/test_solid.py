"""Filled and closed masks against a plain pixel-by-pixel closing, and widened zones against distances."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from floeline.functions import solid
from floeline.operators import surface, zones


def plain_fill(grid):
    h, w = len(grid), len(grid[0])
    todo = [(y, x) for y in range(h) for x in range(w) if (y in (0, h - 1) or x in (0, w - 1)) and not grid[y][x]]
    seen = set(todo)
    while todo:
        y, x = todo.pop()
        for b, a in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= b < h and 0 <= a < w and not grid[b][a] and (b, a) not in seen:
                seen.add((b, a))
                todo.append((b, a))
    return [[(y, x) not in seen for x in range(w)] for y in range(h)]


def plain_close(grid, size):
    h, w, half = len(grid), len(grid[0]), size // 2
    offsets = []
    for dy in range(-half, half + 1):
        reach = round(half * math.sqrt(1 - (dy / half) ** 2)) if half else 0
        offsets += [(dy, dx) for dx in range(-reach, reach + 1)]
    inside = lambda y, x: 0 <= y < h and 0 <= x < w
    wide = [[any(inside(y + b, x + a) and grid[y + b][x + a] for b, a in offsets) for x in range(w)] for y in range(h)]
    return [[all(not inside(y + b, x + a) or wide[y + b][x + a] for b, a in offsets) for x in range(w)] for y in range(h)]


def pictures():
    pick = random.Random(7)
    for h, w in ((1, 1), (1, 9), (7, 1), (6, 11), (16, 16), (23, 9)):
        for share in (0.1, 0.4, 0.7):
            yield [[pick.random() < share for _ in range(w)] for _ in range(h)]
    # a spiral: the way out has many turns
    spiral = [[True] * 13 for _ in range(13)]
    y = x = 0
    for (dy, dx), n in zip([(0, 1), (1, 0), (0, -1), (-1, 0)] * 3, (12, 12, 12, 10, 10, 8, 8, 6, 6, 4, 4, 2), strict=True):
        for _ in range(n):
            spiral[y][x] = False
            y, x = y + dy, x + dx
    yield spiral


@pytest.mark.parametrize("grid", list(pictures()))
def test_against_plain_pixels(grid):
    region = np.array(grid)
    assert (solid.filled(region) == np.array(plain_fill(grid))).all()
    for size in (1, 3, 5, 11):
        assert (solid.closed(region, size) == np.array(plain_close(grid, size))).all()


def test_half_widths():
    assert solid.ellipse(3) == [1, 0] and solid.ellipse(5) == [2, 2, 0] and solid.ellipse(1) == [0]


def test_solid_regions(spark):
    """The hole below the vessel is filled, the vessel itself is not; of two classes the first counts."""
    codes = [[0] * 9 for _ in range(9)]
    for y, x in ((2, 3), (2, 4), (2, 5), (3, 3), (3, 5), (4, 3), (4, 5), (5, 3), (5, 4), (5, 5)):
        codes[y][x] = 1
    codes[3][4], codes[8][8], codes[8][6] = 4, 3, 3
    df = spark.createDataFrame([(1, sum(codes, [])), (2, None), (3, []), (4, [0] * 81)], "frame_id int, mask array<int>")
    got = surface.solid_regions(df, ["frame_id"], 9, {"ice_field": 3, "slush_ice": 3}).collect()
    found = {(r.frame_id, r.class_name): (r.bbox_x1, r.bbox_y1, r.bbox_x2, r.bbox_y2, r.area_pixels) for r in got}
    expected, taken = {}, {(3, 4)}
    for name, code in (("ice_field", 1), ("slush_ice", 3)):
        grid = plain_close(plain_fill([[c == code for c in row] for row in codes]), 3)
        mine = {(y, x) for y in range(9) for x in range(9) if grid[y][x]} - taken
        taken |= mine
        ys, xs = zip(*mine, strict=True)
        expected[1, name] = (min(xs), min(ys), max(xs), max(ys), len(mine))
    assert found == expected and found[1, "ice_field"][4] == 11


def distance(px, py, edge):
    (x1, y1), (x2, y2) = edge
    dx, dy = x2 - x1, y2 - y1
    t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def test_widened_zone(spark):
    corners = [(0.2, 0.2), (0.6, 0.2), (0.6, 0.2), (0.4, 0.7)]
    edges = zones.zone_edges(spark, {"a": corners})
    points = [(i, "a" if i % 9 else "b", (i * 37 % 100) / 100, (i * 53 % 97) / 97) for i in range(300)]
    df = spark.createDataFrame(points, "id int, cam_id string, x double, y double")
    got = {r.id: r for r in zones.mark_widened(df, edges, 400, 300, 60).collect()}
    outline = [((ax * 400, ay * 300), (bx * 400, by * 300)) for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True)]
    for i, cam, x, y in points:
        close = cam == "a" and min(distance(x * 400, y * 300, e) for e in outline) <= 30
        assert got[i].in_widened == (got[i].in_zone or close), i
    assert any(r.in_widened and not r.in_zone for r in got.values()) and not any(r.in_widened for r in got.values() if r.cam_id == "b")


def test_points_are_not_dealt_by_camera(spark):
    """Two cameras would be two tasks; the zones are known to be small without running anything."""
    points = spark.range(1000).selectExpr("id", "if(id % 2 = 0, 'cam_a', 'cam_b') AS cam_id", "id / 1000 AS x", "id % 7 / 7 AS y")
    edges = zones.zone_edges(spark)
    for marked in (zones.mark_zone(points, edges), zones.mark_widened(points, edges, 1280, 720)):
        plan = marked._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
    assert zones.zone_edges(spark, {}).collect() == []


def test_edge_of_the_widened_zone(spark):
    """Just within, at and just beyond the reach of sides, corners and a slanted edge; NULL and missing numbers are outside."""
    corners = [(0.25, 0.25), (0.75, 0.25), (0.5, 0.75)]
    edges = zones.zone_edges(spark, {"a": corners})
    places = [(400 + a * d, y + b * d) for d in (29.99, 30.0, 30.01, 31.01) for a, b in ((-1, 0), (0, -1), (-0.6, -0.8)) for y in (200, 300)]
    points = [(i, "a", x / 1600, y / 800) for i, (x, y) in enumerate(places)] + [(99, "a", None, 0.5), (98, "a", float("nan"), 0.5)]
    df = spark.createDataFrame(points, "id int, cam_id string, x double, y double")
    got = {r.id: r for r in zones.mark_widened(df, edges, 1600, 800, 60).collect()}
    outline = [((ax * 1600, ay * 800), (bx * 1600, by * 800)) for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True)]
    for i, _, x, y in points[:-2]:
        assert got[i].in_widened == (got[i].in_zone or min(distance(x * 1600, y * 800, e) for e in outline) <= 30), places[i]
    assert not got[99].in_widened and not got[98].in_widened


def test_blocked_pixels_are_those_in_the_zone(spark):
    edges = zones.zone_edges(spark)
    found = {r.cam_id: r.blocked for r in zones.blocked_pixels(edges, 12, 9).collect()}
    centres = [(cam, i, (i % 12 + 0.5) / 12, (i // 12 + 0.5) / 9) for cam in found for i in range(108)]
    df = spark.createDataFrame(centres, "cam_id string, i int, x double, y double")
    for r in zones.mark_zone(df, edges).collect():
        assert found[r.cam_id][r.i] == r.in_zone
    wide = {r.cam_id: r.blocked for r in zones.blocked_pixels(edges, 12, 9, 3).collect()}
    assert all(sum(wide[c]) > sum(found[c]) and all(w or not f for w, f in zip(wide[c], found[c], strict=True)) for c in found)


def test_many_masks_are_worked_on_together():
    """Masks of several sizes, NULL and empty ones in one batch, each as it is alone; a slice counts from its own start."""
    pick = random.Random(3)
    rows = [[pick.randrange(5) for _ in range(9 * pick.choice((1, 4, 9)))] for _ in range(60)] + [None, [], [1, None] + [0] * 7]
    classes = {1: 5, 2: 3, 3: 3}
    batch = pa.array(rows, pa.list_(pa.int32()))
    got = solid.solid_batch(batch, 9, classes, 4).to_pylist()
    assert got[60:62] == [None, []] and solid.solid_batch(batch.slice(7, 54), 9, classes, 4).to_pylist() == got[7:61]
    for row, found in zip(rows, got, strict=True):
        if row:
            grid = [[row[y * 9 + x] for x in range(9)] for y in range(len(row) // 9)]
            left = [4 if c == 4 else 0 for c in row]
            for code, size in classes.items():
                if code in row:
                    own = sum(plain_close(plain_fill([[c == code for c in line] for line in grid]), size), [])
                    left = [code if mine and not c else c for mine, c in zip(own, left, strict=True)]
            assert found == left


def test_time_of_many_small_masks():
    """A quarter of a second for 10,000 masks of 64 pixels, not the 13 seconds of one by one."""
    codes = (np.arange(10_000)[:, None] * 7 + np.arange(64) * (1 + np.arange(10_000)[:, None] % 5)) % 5
    batch = pa.array(list(codes.astype(np.int32)))
    started = time.perf_counter()
    solid.solid_batch(batch, 8, {1: 5, 2: 3, 3: 3}, 4)
    assert time.perf_counter() - started < 5
