"""The newest rows of a store against all its rows: late rows, overlapping partitions, and what is opened."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from floeline.operators import zone_map
from floeline.plans import etl
from floeline.sources import tables

START = datetime(2024, 1, 1)


@pytest.fixture
def database(spark, tmp_path):
    name = f"zones_{uuid.uuid4().hex[:8]}"
    tables.create_tables(spark, name, str(tmp_path / "warehouse"))
    return name


def raw(spark, rows):
    made = [(ts, cam, 0.5, 0.1, False, {"ice_field": 1}, ts.date()) for ts, cam in rows]
    return spark.createDataFrame(made, "ts timestamp, cam_id string, ice_conc double, ice_severity double, vessel_present boolean, pixels map<string,int>, dt date")


def ranked(df, n):
    order = Window.partitionBy("cam_id").orderBy(F.desc("ts"))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def same(left, right):
    columns = sorted(right.columns)
    assert sorted(map(str, left.select(*columns).collect())) == sorted(map(str, right.select(*columns).collect()))


def test_late_rows_and_other_cameras_of_a_day(spark, database):
    table = lambda: spark.table(f"{database}.frames")
    zones = lambda: zone_map.stored(spark, database)
    etl.store_frames(raw(spark, [(START + timedelta(days=d, minutes=m), c) for d in range(5) for m in range(20) for c in "ab"]), database)
    same(zone_map.newest_of(table(), zones(), ["cam_id"], ["ts"], 30), ranked(table(), 30))
    # a day in the middle is rewritten with one camera more, and one camera sends again after a gap
    late = [(START + timedelta(days=2, minutes=m), "c") for m in range(7)] + [(START + timedelta(days=6), "a")]
    etl.store_frames(raw(spark, late), database)
    for n in (1, 7, 30, 1000):
        same(zone_map.newest_of(table(), zones(), ["cam_id"], ["ts"], n), ranked(table(), n))
    assert zones().count() == 12
    entry = zones().where("cam_id = 'c'").first()
    assert entry.rows == 7 and entry.newest == START + timedelta(days=2, minutes=6)
    totals = {r.cam_id: r.db_rows for r in zone_map.totals(zones(), ["cam_id"]).collect()}
    assert totals == {"a": 101, "b": 100, "c": 7}


def test_only_the_last_partitions_are_opened(spark, database):
    etl.store_frames(raw(spark, [(START + timedelta(days=d, minutes=m), c) for d in range(9) for m in range(20) for c in "ab"]), database)
    zones = zone_map.stored(spark, database)
    opened = {(r.dt.day, r.cam_id) for r in zone_map.holding_newest(zones, ["cam_id"], 30).collect()}
    assert opened == {(d, c) for d in (8, 9) for c in "ab"}
    found = zone_map.newest_of(spark.table(f"{database}.frames"), zones, ["cam_id"], ["ts"], 30)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dynamicpruning" in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line and "ice_conc" in line]
    assert len([line for line in scans if "dt" in line and "dynamicpruning" in line]) >= 1
    recent = zone_map.since(spark.table(f"{database}.frames"), zones, F.lit(START + timedelta(days=8, minutes=15)), ["cam_id"])
    assert recent.count() == 8


@pytest.mark.parametrize("seed", range(5))
def test_partitions_that_overlap(spark, seed):
    """Days that say nothing about the times in them."""
    pick = random.Random(seed)
    rows = [(pick.choice("ab"), pick.randrange(6), START + timedelta(seconds=pick.randrange(10_000))) for _ in range(200)]
    rows = list({(c, t): (c, d, t) for c, d, t in rows}.values()) + [("a", 2, None), ("d", 1, None)]
    df = spark.createDataFrame(rows, "cam_id string, dt int, ts timestamp")
    zones = zone_map.zones(df, ["cam_id"])
    for n in (1, 10, 90, 500):
        kept = zone_map.holding_newest(zones, ["cam_id"], n)
        opened = df.join(kept, ["dt", "cam_id"], "left_semi")
        order = Window.partitionBy("cam_id").orderBy(F.desc_nulls_last("ts"))
        best = lambda d: d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        same(best(opened), best(df))
