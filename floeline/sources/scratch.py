"""Written intermediate tables in the folder the cluster shares.

A written table cuts lineage and survives lost executors. The folder comes from
`spark.checkpoint.dir`; only a local session may fall back to a folder of its own.
"""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query go when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_roots: dict[str, str] = {}
_used: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}
_databases: dict[str, list[str]] = {}


def root(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="floeline-")
        atexit.register(shutil.rmtree, _own_roots[app], True)
    return _own_roots[app]


def folder(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path under the shared folder."""
    path = f"{root(spark)}/floeline/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _used:
        atexit.register(_release_if_alive, spark)
    _used.setdefault(app, []).append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and go on from the written rows."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_alone(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As `stage`, with the path for `drop`; the shuffle files of the write go when it ends.

    Otherwise Spark keeps them until the driver happens to collect its garbage.
    """
    conf, path = df.sparkSession.conf, folder(df.sparkSession, label)
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(FREED)
        else:
            conf.set(FREED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage_by(df: DataFrame, label: str, by: str, parts: int, order: str) -> DataFrame:
    """Write `df` once in `parts` buckets of the column `by`; what later groups by it needs no shuffle.

    Only a catalog table knows its buckets, so there is one until `release`.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    table = f"floeline_{label}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, by).sortBy(order).option("path", path).saveAsTable(table)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)


def database(spark: SparkSession) -> str:
    """A fresh name for a database that `release` drops."""
    name = f"floeline_{uuid.uuid4().hex[:12]}"
    _databases.setdefault(spark.sparkContext.applicationId, []).append(name)
    return name


def drop(spark: SparkSession, path: str) -> None:
    """Delete one folder before the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    known = _used.get(spark.sparkContext.applicationId, [])
    if path in known:
        known.remove(path)


def release(spark: SparkSession) -> int:
    """Delete the folders, staged tables and databases this application made; results built on them must be done."""
    for table in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for name in _databases.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = _used.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)


def _release_if_alive(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        release(spark)
