"""Quantiles per key from mergeable sketches, and exact ones between the bounds that a sketch gives.

A sketch has a bounded size, whatever the number of rows, and sketches of parts (of days, say) merge
into one of the whole. `exact_quantiles` reads the rows once for the sketch and once more: values
between the bounds of a wanted rank are counted one by one, all others only by the gap that
they lie in. The answer never depends on luck: where a wanted rank turns out to lie in a gap, the bounds
are widened for that key, until they are open in the end.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from floeline.operators import ordering
from floeline.sources import scratch

#: Accuracy of a sketch: it holds about three times as many numbers.
SKETCH_SIZE = 1000
#: Largest number of counted values of a key that one task sorts; more are range-partitioned.
WINDOW_ROWS = 1_000_000


def rank_error(size: int = SKETCH_SIZE) -> float:
    """Share of the rows by which a rank from a sketch is off, with 99 % confidence."""
    return 2.296 / size**0.9723


def _matched(df: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys, NULL keys too, without the keys of the right side."""
    other = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    match = F.lit(True)
    for i, key in enumerate(keys):
        match = match & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    return df.join(other, match, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _usable(value: str) -> Column:
    """Values as a sketch takes them: NaN has no place in it."""
    number = F.col(value).cast("double")
    return F.when(~F.isnan(number), number)


def sketches(df: DataFrame, keys: list[str], value: str, size: int = SKETCH_SIZE) -> DataFrame:
    """One row per key: `n` values (NULL and NaN not counted), `largest`, and the `sketch` (NULL without a value)."""
    return df.groupBy(*keys).agg(
        F.count(_usable(value)).alias("n"),
        F.max(_usable(value)).alias("largest"),
        F.when(F.count(_usable(value)) > 0, F.kll_sketch_agg_double(_usable(value), F.lit(size))).alias("sketch"),
    )


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of parts of a key as one sketch of the key."""
    return parts.where(F.col("n") > 0).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("largest").alias("largest"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def approximate(parts: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles per key from sketches of its parts; ranks are off by `rank_error` at most, as a rule."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return merged(parts, keys).select(*keys, "n", *found, "largest")


def _slots(probs: dict[str, float], interpolate: bool) -> list[tuple[str, float, Column]]:
    """(name, share of the rows, 0-based rank) of the order statistics that are needed, given `_total` rows.

    Ranks use exact decimals, so that p * n never lands beside a whole number.
    """
    slots = []
    for name, p in probs.items():
        share = F.lit(Decimal(str(p)))
        if interpolate:
            at = (F.col("_total") - 1) * share
            slots += [(f"{name}:low", p, F.floor(at)), (f"{name}:high", p, F.ceil(at))]
        else:
            slots.append((name, p, F.greatest(F.ceil(F.col("_total") * share) - 1, F.lit(0))))
    return [(name, p, rank.cast("bigint")) for name, p, rank in slots]


def _bounds(found: DataFrame, shares: list[float], size: int, widen: float) -> DataFrame:
    """Per key and share a lower and an upper bound, NULL where open: also for keys whose values are few anyway."""
    margin = 3 * rank_error(size) * widen
    # NaN values come last and are in no sketch: its top does not bound the rows then
    known = F.col("sketch").isNotNull() & (F.col("n") == F.col("_total")) & (F.col("n") > 4 * size)
    columns = {}
    for i, p in enumerate(shares):
        for name, at in ((f"_low{i}", p - margin), (f"_high{i}", p + margin)):
            bound = F.kll_sketch_get_quantile_double("sketch", F.lit(at)) if 0 < at < 1 else F.lit(None).cast("double")
            columns[name] = F.when(known, bound)
    return found.withColumns(columns).drop("sketch", "n")


def _counted(rows: DataFrame, bounds: DataFrame, keys: list[str], value: str, number: int) -> DataFrame:
    """Values inside bounds with their counts (`_w`), and for each gap one row with a value of it (`_gap`)."""
    v = F.col(value).cast("double")
    inside, gap = F.lit(False), F.lit(0)
    for i in range(number):
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        inside = inside | ((low.isNull() | (v >= low)) & (high.isNull() | (v <= high)))
        gap = gap + F.when(v > high, 1).otherwise(0)
    cells = _matched(rows, bounds, keys).select(
        *keys, F.col(value).alias("_value"), F.when(inside, F.col(value)).alias("_seen"), F.when(~inside, gap).alias("_gap")
    )
    counted = cells.groupBy(*keys, "_seen", "_gap").agg(F.count(F.lit(1)).alias("_w"), F.min("_value").alias("_least"))
    return counted.select(*keys, F.coalesce("_seen", "_least").alias(value), "_w", F.col("_gap").isNotNull().alias("_gap"))


def _hits(counted: DataFrame, totals: DataFrame, keys: list[str], value: str, slots, limit: int) -> DataFrame:
    """(keys, _slot, value, _gap): the counted row that holds each wanted rank."""
    largest = counted.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= limit:
        upto = F.sum("_w").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    else:
        counted, upto = ordering.running(counted, keys, [value], "_w")
    reached = _matched(counted.withColumn("_upto", upto), totals, keys)
    wanted = F.array(*[F.struct(F.lit(name).alias("slot"), rank.alias("at")) for name, _, rank in slots])
    here = F.filter(wanted, lambda w: (w["at"] < F.col("_upto")) & (w["at"] >= F.col("_upto") - F.col("_w")))
    return reached.select(*keys, value, "_gap", "_total", F.explode(here).alias("_hit")).select(
        *keys, value, "_gap", "_total", F.col("_hit.slot").alias("_slot")
    )


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    interpolate: bool = True,
    size: int = SKETCH_SIZE,
    limit: int = WINDOW_ROWS,
) -> DataFrame:
    """Exact quantiles per key: one row with `n` and a column per entry of `probs`.

    With `interpolate`, linear between the two neighbours; otherwise the smallest value that at
    least a share p of the rows does not exceed. NULL values are not counted, NaN is the largest value.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    total = F.count(F.lit(1)).alias("_total")
    found = rows.groupBy(*keys).agg(
        total,
        F.count(_usable(value)).alias("n"),
        F.when(F.count(_usable(value)) > 0, F.kll_sketch_agg_double(_usable(value), F.lit(size))).alias("sketch"),
    )
    found = scratch.stage(found, "sketches")
    slots = _slots(probs, interpolate)
    shares = list(dict.fromkeys(p for _, p, _ in slots))
    done, left, widen = None, found, 1.0
    while True:
        bounds = scratch.stage(_bounds(left, shares, size, widen), "bounds")
        counted = scratch.stage(_counted(rows, bounds, keys, value, len(shares)), "counted")
        hits = scratch.stage(_hits(counted, bounds.select(*keys, "_total"), keys, value, slots, limit), "hits")
        missed = hits.where("_gap").select(*keys).distinct()
        if missed.isEmpty():
            done = hits if done is None else done.unionByName(hits)
            break
        good = _matched(hits, missed, keys, "left_anti")
        done = good if done is None else done.unionByName(good)
        left, widen = _matched(left, missed, keys, "left_semi"), widen * 8
    hits = done.groupBy(*keys).agg(
        F.max("_total").alias("n"), *[F.max(F.when(F.col("_slot") == name, F.col(value))).alias(name) for name, _, _ in slots]
    )
    if not interpolate:
        return hits.select(*keys, "n", *probs)
    out = []
    for name, p in probs.items():
        low, high = F.col(f"`{name}:low`"), F.col(f"`{name}:high`")
        at = ((F.col("n") - 1) * F.lit(Decimal(str(p)))).cast("double")
        out.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return hits.select(*keys, "n", *out)
