"""Message stream to partitioned Parquet."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from floeline import schemas
from floeline.operators import messages
from floeline.sources import manifest, tables

TOPIC = "ice.detections"
TRIGGER = "30 seconds"
#: Batches after which the folders of a partition are merged.
MERGE_EVERY = 20


def kafka_source_options(
    servers: str, topic: str, starting: str, max_offsets: int | None, fail_on_data_loss: bool
) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    return options if max_offsets is None else {**options, "maxOffsetsPerTrigger": str(max_offsets)}


def kafka_messages(
    spark: SparkSession,
    servers: str,
    topic: str = TOPIC,
    starting: str = "earliest",
    max_offsets: int | None = None,
    fail_on_data_loss: bool = True,
) -> DataFrame:
    """Topic as a stream; needs the Kafka connector on the class path.

    A batch takes all that has arrived unless `max_offsets` bounds it; a bound below the rate of the
    topic makes a backlog that its retention may delete. Lost messages stop the query unless
    `fail_on_data_loss` is False.
    """
    options = kafka_source_options(servers, topic, starting, max_offsets, fail_on_data_loss)
    return spark.readStream.format("kafka").options(**options).load()


def text_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of text files, one message per line, as a stream; `max_files` bounds a batch."""
    reader = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", str(max_files))
    return reader.text(path)


def _trigger(writer, once: bool, every: str):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)


def parquet_sink(
    stream: DataFrame, path: str, checkpoint: str, name: str, once: bool = False, every: str = TRIGGER
) -> StreamingQuery:
    """Append to Parquet by date and camera; the sink's own log makes it exactly-once."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("dt", "cam_id")
        .outputMode("append")
        .queryName(name)
    )
    return _trigger(writer, once, every).start()


def start_two_queries(
    source: DataFrame, base: str, grain: str = "micro", once: bool = False, every: str = TRIGGER
) -> list[StreamingQuery]:
    """A frame query and a detection query, each reading the source by itself."""
    parsed = messages.parse(source, grain=grain)
    parts = {"frames": messages.frames(parsed), "ice_detections": messages.detections(parsed)}
    return [
        parquet_sink(stream, f"{base}/raw/{name}", f"{base}/checkpoints/{name}", name, once, every)
        for name, stream in parts.items()
    ]


def store_batch(batch: DataFrame, base: str, run: str, batch_id: int, merge_every: int | None = MERGE_EVERY) -> None:
    """Both parts of a batch, below their day and camera in a folder that only this run and batch write."""
    kept = batch.persist()
    by = tables.PARTITION_COLUMNS
    try:
        parts = {
            "frames": (messages.frames(kept), schemas.RAW_FRAMES),
            "ice_detections": (messages.detections(kept), schemas.RAW_DETECTIONS),
        }
        for name, (rows, schema) in parts.items():
            manifest.append(rows, f"{base}/raw/{name}", by, run, batch_id)
            manifest.upkeep(batch.sparkSession, f"{base}/raw/{name}", schema, by, batch_id, merge_every)
    finally:
        kept.unpersist()


def start_single_read(
    source: DataFrame,
    base: str,
    grain: str = "micro",
    once: bool = False,
    every: str = TRIGGER,
    merge_every: int | None = MERGE_EVERY,
) -> StreamingQuery:
    """Both sinks from one read of the source.

    A batch that runs again after a failure overwrites its own folders and is counted once. The name of the
    run lies in the checkpoint: with a new checkpoint the numbers of batches begin anew, and what earlier
    runs have stored stays. After each `merge_every` batches the folders of a partition are merged; the
    readers of `sources/readers.py` see each row once all the while.
    """
    checkpoint = f"{base}/checkpoints/single"
    run = tables.run_name(source.sparkSession, checkpoint)
    writer = (
        messages.parse(source, grain=grain)
        .writeStream.foreachBatch(lambda batch, batch_id: store_batch(batch, base, run, batch_id, merge_every))
        .option("checkpointLocation", checkpoint)
        .queryName("normaliser")
    )
    return _trigger(writer, once, every).start()


def await_any(spark: SparkSession, queries: list[StreamingQuery]) -> None:
    """Wait until one query ends, then stop the others; its failure is raised."""
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for query in queries:
            query.stop()


def drain(queries: list[StreamingQuery]) -> None:
    """Wait for queries that run until their input is used up."""
    for query in queries:
        query.awaitTermination()


def write_messages(df: DataFrame, path: str) -> None:
    """Encoded messages as text files."""
    messages.encode(df).write.mode("append").text(path)


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def kafka_sink(df: DataFrame, servers: str, topic: str = TOPIC) -> None:
    """Encoded messages to a topic; needs the Kafka connector on the class path."""
    messages.encode(df).write.format("kafka").options(**kafka_sink_options(servers, topic)).save()


def kafka_stream_sink(
    stream: DataFrame, servers: str, checkpoint: str, topic: str = TOPIC, once: bool = False, every: str = TRIGGER
) -> StreamingQuery:
    """The same for a stream; a restart may send the last batch again."""
    writer = messages.encode(stream).writeStream.format("kafka").options(**kafka_sink_options(servers, topic))
    return _trigger(writer.option("checkpointLocation", checkpoint), once, every).start()
