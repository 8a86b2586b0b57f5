"""Catalog tables: definition, partition overwrite, counts."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from floeline import schemas

PARTITION_COLUMNS = ("dt", "cam_id")
FIRST_DAY = "DATE'1900-01-01'"


def create_tables(spark: SparkSession, database: str, location: str | None = None) -> None:
    """Create the database, its three tables and the times of their partitions where they are missing."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{where}")
    zones = {schemas.ZONE_TABLE: schemas.ZONE_COLUMNS}
    for name, (columns, partitions) in {**schemas.TABLES, **zones}.items():
        by = ", ".join(part.split()[0] for part in partitions.split(", "))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}, {partitions}) USING parquet PARTITIONED BY ({by})"
        )


def ensure_folder(spark: SparkSession, path: str) -> None:
    """A stream needs its folder before the first file is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def run_name(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives as long as the checkpoint; a new checkpoint gets a new one."""
    path = f"{checkpoint}/run"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        spark.createDataFrame([(uuid.uuid4().hex[:12],)], "run string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path).first()[0]


def overwrite_partitions(df: DataFrame, table: str, partitions=PARTITION_COLUMNS) -> None:
    """Replace the partitions that `df` holds and leave all others.

    `insertInto` goes by position, so partition columns move last. The rebalance hint groups rows
    by partition for few files, while adaptive execution splits a partition that is too large for
    one task. The setting stays: switching it back and forth would race with other streams.
    """
    ordered = df.select(*[c for c in df.columns if c not in partitions], *partitions)
    spark = df.sparkSession
    key = "spark.sql.sources.partitionOverwriteMode"
    if spark.conf.get(key).lower() != "dynamic":
        spark.conf.set(key, "dynamic")
    ordered.hint("rebalance", *[F.col(c) for c in partitions]).write.insertInto(table, overwrite=True)


def only(df: DataFrame, keys: DataFrame, columns=PARTITION_COLUMNS) -> DataFrame:
    """Rows of `df` whose partition is in `keys`.

    Plain equality and a range on the side of the keys let Spark prune partitions while it runs, for
    any number of them. Keys with a NULL or an older date are rare and get a branch of their own.
    """
    plain = F.expr(f"dt >= {FIRST_DAY}")
    for column in columns:
        plain = plain & F.col(column).isNotNull()
    odd = ~F.coalesce(plain, F.lit(False))
    named = {c: f"_{c}" for c in columns}
    right = keys.select(*columns).distinct()
    usual = df.join(right.where(plain), list(columns), "left_semi")
    others = right.where(odd).withColumnsRenamed(named)
    match = F.lit(True)
    for column, other in named.items():
        match = match & F.col(column).eqNullSafe(F.col(other))
    return usual.select(*df.columns).unionByName(df.where(odd).join(others, match, "left_semi"))


def overwrite_table(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").format("parquet").saveAsTable(table)


def table_counts(spark: SparkSession, database: str, names=tuple(schemas.TABLES)) -> DataFrame:
    """One row per table with its row count."""
    counts = [
        spark.table(f"{database}.{name}").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows"
        )
        for name in names
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out
