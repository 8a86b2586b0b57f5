"""Streams: equal to the batch path, nothing twice after a restart."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from floeline import schemas
from floeline.operators import messages
from floeline.sources import derived, scratch
from floeline.streaming import normaliser, tables


@pytest.fixture
def folder(spark, small, tmp_path):
    """Messages in four files."""
    base = str(tmp_path)
    normaliser.write_messages(derived.timed_messages(spark, small).repartition(4), f"{base}/in")
    return base


def batch_frames(spark, base):
    return messages.frames(messages.parse(spark.read.text(f"{base}/in"))).drop("pixels")


def stored_frames(spark, base):
    return spark.read.schema(schemas.RAW_FRAMES).parquet(f"{base}/raw/frames").select(
        "ts", "cam_id", "ice_conc", "ice_severity", "vessel_present", "dt"
    )


def same(left, right):
    assert left.count() == right.count() > 0
    assert left.exceptAll(right).isEmpty()


@pytest.mark.parametrize("kind", ["two", "single"])
def test_stream_equals_batch_and_restarts_cleanly(spark, folder, kind):
    def run():
        source = normaliser.text_messages(spark, f"{folder}/in", max_files=1)
        if kind == "two":
            normaliser.drain(normaliser.start_two_queries(source, folder, once=True))
        else:
            normaliser.drain([normaliser.start_single_read(source, folder, once=True)])

    run()
    same(stored_frames(spark, folder), batch_frames(spark, folder))
    found = spark.read.schema(schemas.RAW_DETECTIONS).parquet(f"{folder}/raw/ice_detections")
    assert found.count() == messages.detections(messages.parse(spark.read.text(f"{folder}/in"))).count()
    run()
    same(stored_frames(spark, folder), batch_frames(spark, folder))


def test_repeated_batch_overwrites_itself(spark, folder):
    batch = messages.parse(spark.read.text(f"{folder}/in"))
    for _ in range(2):
        normaliser.store_batch(batch, folder, "run", 0)
    same(stored_frames(spark, folder), batch_frames(spark, folder))


def test_a_new_checkpoint_keeps_stored_rows(spark, folder):
    def run():
        normaliser.start_single_read(normaliser.text_messages(spark, f"{folder}/in"), folder, once=True).awaitTermination()

    run()
    scratch.drop(spark, f"{folder}/checkpoints/single")
    run()
    assert stored_frames(spark, folder).count() == 2 * batch_frames(spark, folder).count()
    assert stored_frames(spark, folder).exceptAll(batch_frames(spark, folder).unionAll(batch_frames(spark, folder))).isEmpty()


def test_kafka_options():
    plain = normaliser.kafka_source_options("h:1", "t", "earliest", None, True)
    assert plain == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest", "failOnDataLoss": "true"}
    bounded = normaliser.kafka_source_options("h:1", "t", "latest", 10, False)
    assert bounded["maxOffsetsPerTrigger"] == "10" and bounded["failOnDataLoss"] == "false"
    assert normaliser.kafka_sink_options("h:1", "t") == {"kafka.bootstrap.servers": "h:1", "topic": "t"}


def test_kafka_needs_its_connector(spark):
    with pytest.raises(AnalysisException, match="kafka"):
        normaliser.kafka_messages(spark, "localhost:9092")


def test_latest_per_camera(spark, folder):
    frames = messages.frames(messages.parse(normaliser.text_messages(spark, f"{folder}/in", 1))).drop("pixels", "dt")
    tables.latest_per_camera(frames, f"{folder}/latest", f"{folder}/ck", once=True).awaitTermination()
    got = {r.cam_id: r.ts for r in tables.read_latest(spark, f"{folder}/latest", frames.schema).collect()}
    expected = batch_frames(spark, folder).groupBy("cam_id").agg(F.max("ts").alias("ts")).collect()
    assert got == {r.cam_id: r.ts for r in expected}


def test_two_queries_stop_together(spark, folder):
    source = normaliser.text_messages(spark, f"{folder}/in")
    queries = normaliser.start_two_queries(source, folder, every="1 second")
    queries[0].processAllAvailable()
    queries[0].stop()
    normaliser.await_any(spark, queries)
    assert not any(q.isActive for q in queries)
    spark.streams.resetTerminated()
