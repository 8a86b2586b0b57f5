"""Ordered computations that do not put a whole key into one task.

A window partitioned by camera alone sends all rows of a camera to one task. Here rows are
range-partitioned on (keys, order) instead, which balances whatever the keys are, and written
once, so that every later step sees the same partitions. From the written rows:

* `number_rows` gives each row its position within its key,
* `windowed` looks a few rows back within each written partition, and hands each partition the last
  rows of those before it (at most as many rows a partition as are looked back at),
* `running` adds up a column along the order.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from floeline.session import shuffle_width
from floeline.sources import scratch

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above this bit
_MOST_BUCKETS = 100_000  # Spark's own limit; the rows of a partition stay narrow


_UNKNOWN_BYTES = 2**60


def width(df: DataFrame, least: int | None = None) -> int:
    """Partitions for a full shuffle of `df`: by the size of the files it reads, at least `least` or the session's number."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a leaf without files has no size of its own
    return shuffle_width(sum(s for s in sizes if s < _UNKNOWN_BYTES), least=least)


def _sorted(df: DataFrame, keys: list[str], order: list[str], parts: int) -> DataFrame:
    """Balanced partitions in the order of (keys, order), with partition and row number."""
    ranged = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    numbered = ranged.withColumn("_row", F.monotonically_increasing_id())
    return numbered.withColumn("_part", F.shiftright("_row", _PART_BITS))


def _place(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    return scratch.stage(_sorted(df, keys, order, parts or width(df)), "placed")


def _spans(placed: DataFrame, keys: list[str], rows: Column) -> DataFrame:
    """One row per key and partition: rows there, rows before it, rows of the key in all.

    Staged, so that the planner knows its size and broadcasts it when, and only when, it is small.
    """
    tally = placed.groupBy(*keys, "_part").agg(rows.alias("_here"), F.min("_row").alias("_first"))
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = tally.withColumns(
        {
            "_before": F.coalesce(F.sum("_here").over(earlier), F.lit(0)),
            "_total": F.sum("_here").over(by_key),
        }
    )
    return scratch.stage(spans, "spans")


def _join_spans(placed: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Attach spans; joining on the partition too keeps a large key spread."""
    right = spans.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_p"),
        *[c for c in spans.columns if c not in (*keys, "_part")],
    )
    match = F.col("_part") == F.col("_p")
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(right, match).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def number_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add `position` (0-based within the key) and `key_rows`. (keys, order) must be unique."""
    placed = _place(df, keys, order)
    spans = _spans(placed, keys, F.count(F.lit(1))).drop("_here")
    return (
        _join_spans(placed, spans, keys)
        .withColumn("position", F.col("_before") + F.col("_row") - F.col("_first"))
        .withColumn("key_rows", F.col("_total"))
        .drop("_row", "_part", "_first", "_before", "_total")
    )


def windowed(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    back: int,
    looked_at: list[str],
    columns: Callable[[Callable[[str, int], Column], Column], dict[str, Column]],
    parts: int | None = None,
) -> DataFrame:
    """Add columns that look at most `back` rows behind. (keys, order) must be unique.

    `columns(before, rows)` returns the new columns: `before(name, i)` is the value of a column of
    `looked_at` i rows earlier, NULL where there is no such row; `rows` is the number of earlier
    rows of the key, counted up to `back`. The rows are shuffled once: the windows run inside the
    written partitions, whose first rows take what is missing from the rows handed over.
    """
    if back < 1:
        raise ValueError("at least one row must be looked at")
    parts = min(parts or width(df), _MOST_BUCKETS)
    placed = scratch.stage_by(_sorted(df, keys, order, parts), "placed", "_part", parts, "_row")
    handed = _handed_over(placed, keys, back, looked_at)
    on_part = Window.partitionBy(*keys, "_part").orderBy("_row")
    here = placed.withColumn("_nth", F.row_number().over(on_part) - 1)
    here = here.withColumns({f"_{name}_{i}": F.lag(name, i).over(on_part) for name in looked_at for i in range(1, back + 1)})
    joined = _join_by_part(here, handed, keys)
    carried = F.coalesce(F.size("_halo"), F.lit(0))

    def before(name: str, i: int) -> Column:
        from_halo = F.get(F.col("_halo"), carried - (F.lit(i) - F.col("_nth")))[name]
        return F.when(F.col("_nth") >= i, F.col(f"_{name}_{i}")).otherwise(from_halo)

    rows = F.least(F.col("_nth") + carried, F.lit(back))
    return joined.select(*df.columns, *[column.alias(name) for name, column in columns(before, rows).items()])


def _handed_over(placed: DataFrame, keys: list[str], back: int, looked_at: list[str]) -> DataFrame:
    """Per partition whose first key began earlier: the key, and the `back` rows in front as `_halo`, oldest first.

    Only the last key of a partition can go on in the next one, so a partition hands over at most
    `back` rows. A partition with fewer rows of its key lets those before it reach further.
    """
    ends = scratch.stage(placed.groupBy("_part").agg(F.max("_row").alias("_last")), "ends")
    ends = ends.withColumnRenamed("_part", "_p")
    narrow = placed.select(*keys, *[c for c in looked_at if c not in keys], "_part", "_row")
    first = F.col("_row") == F.shiftleft("_part", _PART_BITS)
    near_end = F.col("_row") > F.col("_last") - back
    edge = narrow.join(ends, F.col("_part") == F.col("_p")).drop("_p").where(first | near_end)
    edge = scratch.stage(edge.withColumns({"_is_first": first, "_at_end": near_end}), "edges")
    row = F.struct("_row", *looked_at)
    by_key = edge.groupBy(*keys, "_part").agg(
        F.bool_or("_is_first").alias("_opens"),
        # only the partition's last key can be met again, so rows of others are of no use
        F.when(F.bool_or(F.col("_row") == F.col("_last")), F.sort_array(F.collect_list(F.when(F.col("_at_end"), row)))).alias("_tail"),
    )
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(-back, -1)
    halo = F.flatten(F.collect_list("_tail").over(ahead))
    kept = F.slice(halo, F.greatest(F.size(halo) - back + 1, F.lit(1)), back)
    return by_key.withColumn("_halo", kept).where(F.col("_opens") & (F.size("_halo") > 0)).select(*keys, "_part", "_halo")


def _join_by_part(placed: DataFrame, by_part: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on partition and keys, NULL keys too; the right side has a row a partition at most."""
    right = by_part.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), *[c for c in by_part.columns if c not in (*keys, "_part")]
    )
    match = F.col("_part") == F.col("_p")
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(right, match, "left")


def since_cutoff(df: DataFrame, keys: list[str], time: str, n: int) -> DataFrame:
    """Rows that can be among the newest `n` of their key: those from the n-th newest row's hour on.

    Hours are counted from two narrow columns by hash aggregation; the rows left over are few, so
    nothing large is sorted later. Rows without a time count as the oldest.
    """
    kind = df.schema[time].dataType
    at = F.coalesce(F.col(time), F.lit("0001-01-01 00:00:00").cast(kind))
    hour = F.date_trunc("hour", at).cast(kind).alias("_hour")
    hours = df.groupBy(*keys, hour).agg(F.count(F.lit(1)).alias("_n"))
    newer = Window.partitionBy(*keys).orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    needed = hours.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(F.col("_newer") < n)
    cutoffs = scratch.stage(
        needed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_hour").alias("_since")),
        "cutoffs",
    )
    match = at >= F.col("_since")
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    return df.join(cutoffs, match).select(*df.columns)


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int, salts: int = 64) -> DataFrame:
    """Newest `n` rows per key, with `rank` 1 for the newest; `order` starts with the time.

    After the cut to recent hours come two rounds, so that a crowded hour is not one task's work:
    first within (key, salt), then over at most salts * n survivors per key.
    """
    newest = [F.col(c).desc() for c in order]
    recent = since_cutoff(df, keys, order[0], n)
    salted = recent.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*newest)
    last = Window.partitionBy(*keys).orderBy(*newest)
    return (
        salted.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= n)
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= n)
        .drop("_salt")
    )


def last_n_of_many(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The same as `last_n` for keys too many for a table of cutoffs.

    Spark limits each key to `n` rows in front of the shuffle, so a large key is not one task's work.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def running(df: DataFrame, keys: list[str], order: list[str], weight: str) -> tuple[DataFrame, Column]:
    """The rows in balanced partitions, and the sum of `weight` up to each row of its key as a column of them."""
    placed = _place(df, keys, order)
    spans = _spans(placed, keys, F.sum(weight)).select(*keys, "_part", "_before")
    here = F.sum(weight).over(Window.partitionBy(*keys, "_part").orderBy("_row"))
    return _join_spans(placed, spans, keys), F.col("_before") + here
