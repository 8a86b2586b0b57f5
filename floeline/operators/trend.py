"""Per-camera ordered series: smoothing, newest rows, repeats, milestones."""

from pyspark.sql import Column, DataFrame, functions as F

from floeline import schemas
from floeline.functions.numbers import clamp01
from floeline.operators.ordering import last_n, number_rows, since_cutoff, windowed


def _blend(oldest_first: list[Column], alpha: float) -> Column:
    """Exponential smoothing, seeded with the first value that is there."""
    result = oldest_first[0]
    for value in oldest_first[1:]:
        result = F.coalesce(F.lit(alpha) * value + F.lit(1.0 - alpha) * result, value)
    return result


def smoothed(
    df: DataFrame,
    value: str,
    keys: list[str],
    order: list[str],
    name: str = "trend",
    points: int = schemas.TREND_WINDOW,
    alpha: float = schemas.TREND_ALPHA,
    parts: int | None = None,
) -> DataFrame:
    """Add the smoothed mean of the last `points` clamped values; a missing value counts as 0."""
    ready = df.withColumn("_v", clamp01(F.coalesce(F.col(value), F.lit(0.0))))

    def trend(before, rows):
        return {name: _blend([*(before("_v", i) for i in range(points - 1, 0, -1)), F.col("_v")], alpha)}

    return windowed(ready, keys, order, points - 1, ["_v"], trend, parts).drop("_v")


def smooth_array(values: Column, alpha: float = schemas.TREND_ALPHA) -> Column:
    """The same over one short array, oldest first; 0 when it is empty."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    step = F.aggregate(
        rest, F.get(values, F.lit(0)), lambda acc, v: F.lit(alpha) * v + F.lit(1.0 - alpha) * acc
    )
    return F.coalesce(step, F.lit(0.0))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; `order` starts with the time and breaks ties with the rest.

    Comparing whole rows makes Spark sort its input, so only rows of the newest hour get that far.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    recent = since_cutoff(df, keys, order[0], 1)
    return recent.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def trend_card(df: DataFrame, value: str, keys: list[str], order: list[str], points: int = schemas.TREND_POINTS):
    """Current, mean and peak of the newest clamped points."""
    return card_of(last_n(df.select(*keys, *order, value), keys, order, points), value, keys)


def card_of(kept: DataFrame, value: str, keys: list[str]):
    """The card of rows that are chosen already, `rank` 1 for the newest."""
    kept = kept.withColumn("_v", clamp01(F.coalesce(F.col(value), F.lit(0.0))))
    return kept.groupBy(*keys).agg(
        F.min_by("_v", "rank").alias("current_value"),
        F.avg("_v").alias("mean_value"),
        F.max("_v").alias("peak_value"),
        F.count(F.lit(1)).alias("points"),
    )


def skip_repeats(df: DataFrame, keys: list[str], order: list[str], message_id: str, parts: int | None = None):
    """Drop rows whose id equals that of the row before, per key."""

    def repeats(before, rows):
        return {"_repeat": (rows > 0) & F.col(message_id).eqNullSafe(before(message_id, 1))}

    return windowed(df, keys, order, 1, [message_id], repeats, parts).where(~F.col("_repeat")).drop("_repeat")


def milestones(df: DataFrame, keys: list[str], order: list[str], every: int) -> DataFrame:
    """Every n-th row per key with its running number."""
    numbered = number_rows(df, keys, order).withColumn("frame_number", F.col("position") + 1)
    return numbered.where(F.col("frame_number") % every == 0).drop("position", "key_rows")
