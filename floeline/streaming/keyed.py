"""Results with one row per key, kept up to date by streams as small deltas.

A batch writes only the keys that changed, with a number that grows with every batch and run. Reading merges them: of
the rows of a key the newest counts, by its order columns, then by that number. From time to time the deltas are
folded into one folder; what a batch writes follows the changed keys, not all of them.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from floeline.sources.tables import run_name
from floeline.sources import manifest

NUMBER = "_number"
FOLD_EVERY = 20


def newest(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order, NUMBER)).alias("_row")
    return rows.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*rows.columns)


def _stored(schema: StructType) -> StructType:
    return StructType(list(schema.fields)).add(NUMBER, LongType())


def store(
    changed: DataFrame, path: str, run: str, batch_id: int, keys: tuple[str, ...], order: tuple[str, ...] = (), every: int | None = FOLD_EVERY
) -> None:
    """Commits the changed rows of a batch."""
    spark, schema = changed.sparkSession, _stored(changed.schema)
    number = manifest.start_run(spark, path, run).sequence(run, batch_id)
    manifest.append(changed.withColumn(NUMBER, F.lit(number)), path, (), run, batch_id)
    manifest.upkeep(spark, path, schema, (), batch_id, every, lambda rows: newest(rows, keys, order))


def read(spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """One row per key; no rows if nothing is stored."""
    return newest(manifest.read(spark, path, _stored(schema)), keys, order).drop(NUMBER)


def start(
    changes: DataFrame,
    path: str,
    checkpoint: str,
    keys: tuple[str, ...],
    order: tuple[str, ...] = (),
    once: bool = False,
    every: str = "30 seconds",
    fold_every: int | None = FOLD_EVERY,
) -> StreamingQuery:
    """Follows a stream of aggregates by `keys` in update mode."""
    run = run_name(changes.sparkSession, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch, path, run, batch_id, keys, order, fold_every)

    writer = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()
