"""Batch readers with declared schemas."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from floeline import schemas
from floeline.sources import manifest


def parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Partitioned Parquet; a path that does not exist yet gives a typed empty frame."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A raw folder: what its manifest names where it has one, else all that is there."""
    if manifest.exists(spark, path):
        return manifest.read(spark, path, schema)
    return parquet_or_empty(spark, path, schema)


def raw_frames(spark: SparkSession, path: str) -> DataFrame:
    return committed(spark, path, schemas.RAW_FRAMES)


def raw_detections(spark: SparkSession, path: str) -> DataFrame:
    return committed(spark, path, schemas.RAW_DETECTIONS)


def latency_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LATENCY_TRIALS).csv(path, header=True)
