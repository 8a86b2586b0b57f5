"""Times and row counts of the partitions of a table, and reading only those that hold the newest rows.

A row per partition (day and camera) says between which times its rows lie and how many they are. It is
written with the partitions, so that a query for the newest rows opens the few partitions that can hold
them and never reads the history. Nothing is assumed of the days: partitions may overlap in time, and rows
that come late widen the entry of their partition when it is rewritten.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from floeline import schemas
from floeline.operators.ordering import last_n_of_many
from floeline.sources import tables


def zones(rows: DataFrame, keys: list[str], time: str = "ts", day: str = "dt") -> DataFrame:
    """The entries of the partitions (day, keys) of `rows`; rows without a time are not counted."""
    return rows.groupBy(day, *keys).agg(
        F.min(time).alias("oldest"),
        F.max(time).alias("newest"),
        F.count(time).alias("rows"),
    )


def refresh(days: DataFrame, database: str) -> None:
    """Replace the entries of the days that `days`, all rows of some days of the frame table, cover."""
    found = zones(days, ["cam_id"]).select("cam_id", "oldest", "newest", "rows", "dt")
    tables.overwrite_partitions(found, f"{database}.{schemas.ZONE_TABLE}", ("dt",))


def stored(spark: SparkSession, database: str) -> DataFrame:
    return spark.table(f"{database}.{schemas.ZONE_TABLE}")


def holding_newest(zone_rows: DataFrame, keys: list[str], n: int, day: str = "dt") -> DataFrame:
    """(day, keys) of the partitions that can hold one of the newest `n` rows of their key.

    Partitions that begin at or after some time and hold n rows together bound the answer: no row before
    that time is among the newest n, whatever partition it is in. Keys with fewer timed rows than n get all.
    """
    later = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("oldest"))
    whole = Window.partitionBy(*keys)
    upto = zone_rows.withColumn("_upto", F.sum("rows").over(later))
    since = upto.withColumn("_since", F.max(F.when(F.col("_upto") >= n, F.col("oldest"))).over(whole))
    kept = since.where(F.col("_since").isNull() | (F.col("newest") >= F.col("_since")))
    return kept.select(day, *keys)


def newest_of(table: DataFrame, zone_rows: DataFrame, keys: list[str], order: list[str], n: int, day: str = "dt") -> DataFrame:
    """Newest `n` rows per key with `rank`, 1 for the newest; only partitions that can hold them are opened."""
    opened = tables.only(table, holding_newest(zone_rows, keys, n, day), (day, *keys))
    return last_n_of_many(opened, keys, order, n)


def latest(zone_rows: DataFrame) -> Column:
    """The newest time of all, as a lazy scalar; no row of the table is read."""
    return zone_rows.select(F.max("newest")).scalar()


def since(table: DataFrame, zone_rows: DataFrame, start: Column, keys: list[str], time: str = "ts", day: str = "dt") -> DataFrame:
    """Rows after `start`, from the partitions that have any."""
    return tables.only(table, zone_rows.where(F.col("newest") > start).select(day, *keys), (day, *keys)).where(F.col(time) > start)


def totals(zone_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and newest time per key from the entries alone."""
    return zone_rows.groupBy(*keys).agg(F.sum("rows").alias("db_rows"), F.max("newest").alias("last_db_ts"))
