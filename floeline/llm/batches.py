"""What tasks in Python need: record batches of bounded size, and this package on their path."""

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of a batch at most; with long texts a batch of the default size would not fit a worker.
ROWS = 1000
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def reachable(spark: SparkSession) -> None:
    """Lets Python workers find the package where the driver found it; a cluster gets it by --py-files or an install."""
    own, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if own not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, own])


def bounded(spark: SparkSession, rows: int = ROWS) -> None:
    reachable(spark)
    if not 0 < int(spark.conf.get(SETTING)) <= rows:
        spark.conf.set(SETTING, str(rows))
