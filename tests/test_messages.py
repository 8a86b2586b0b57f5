"""Parsing edge rows and the round trip of a message."""

import json

import pytest
from pyspark.sql import functions as F

from floeline.operators import messages
from floeline.sources import derived


def message(**changes):
    base = {
        "ts": 1776762270.434759, "cam_id": "cam_a", "ice_conc": 0.5, "ice_severity": 0.1, "vessel_present": True,
        "pixels": {"vessel": 3, "ice_field": 7}, "extra": [1, 2],
        "detections": [{"class_name": "ice_field", "confidence": 0.9, "area_pixels": 7, "bbox": [1, 2, 3, 4]}],
    }
    return json.dumps({k: v for k, v in (base | changes).items() if v != "drop"})


def detection(**changes):
    base = {"class_name": "slush_ice", "confidence": 0.4, "area_pixels": 5, "bbox": [1, 2, 3, 4]}
    return [{k: v for k, v in (base | changes).items() if v != "drop"}]


CASES = {
    "valid": (message(), 1, [(7, 1, 2, 3, 4)]),
    "broken": ("{not json", 0, []),
    "null": (None, 0, []),
    "empty": ("", 0, []),
    "text time": (message(ts="soon"), 0, []),
    "no camera": (message(cam_id=None), 0, []),
    "fraction of a pixel": (message(detections=detection(area_pixels=3.7)), 1, [(None, 1, 2, 3, 4)]),
    "short box": (message(detections=detection(bbox=[8, 9])), 1, [(5, 8, 9, None, None)]),
    "no box": (message(detections=detection(bbox="drop")), 1, [(5, None, None, None, None)]),
    "no detections": (message(detections=[]), 1, []),
    "missing detections": (message(detections="drop"), 1, []),
}


@pytest.mark.parametrize("name", CASES)
def test_edge_rows(spark, name):
    text, frames, boxes = CASES[name]
    parsed = messages.parse(spark.createDataFrame([(text,)], "value string"))
    assert messages.frames(parsed).count() == frames
    found = messages.detections(parsed).select("area_pixels", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")
    assert [tuple(r) for r in found.collect()] == boxes


def test_binary_value_and_missing_pixels(spark):
    df = spark.createDataFrame([(bytearray(message(pixels={"ice_field": 1}), "utf-8"),)], "value binary")
    row = messages.frames(messages.parse(df)).select(F.col("pixels")["vessel"].alias("v"), "ts", "dt").first()
    assert row.v is None and row.ts.microsecond == 434759 and str(row.dt) == "2026-04-21"


def test_second_grain(spark):
    df = spark.createDataFrame([(message(),)], "value string")
    assert messages.frames(messages.parse(df, grain="second")).first().ts.microsecond == 0


def test_text_is_parsed_once(spark):
    df = spark.createDataFrame([(message(),)], "value string")
    plan = messages.frames(messages.parse(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_encode_leaves_out_nulls(spark, small):
    text = messages.encode(derived.timed_messages(spark, small)).first().value
    assert {"ts", "source_ts", "cam_id", "pixels", "detections"} <= set(json.loads(text))
    row = spark.createDataFrame([(1.0, None)], "ts double, cam_id string")
    assert messages.encode(row).first().value == '{"ts":1.0}'


def test_live_metrics_and_names(spark):
    row = spark.createDataFrame(
        [("10.5", "cam_a", "0.5", "x", "1", '{"vessel": 2}')],
        "ts string, cam_id string, ice_conc string, ice_severity string, vessel_present string, pixels_json string",
    )
    got = messages.live_metrics(row).withColumn("vessel", messages.pixel_map(F.col("pixels_json"))["vessel"]).first()
    assert (got.ice_conc, got.ice_severity, got.vessel_present, got.vessel) == (0.5, None, True, 2)
    assert row.select(messages.stream_name("frames", F.col("cam_id")).alias("n")).first().n == "frames:cam_a"
