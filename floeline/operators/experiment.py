"""Scaling experiment and latency summaries."""

from pyspark.sql import Column, DataFrame, functions as F

from floeline.functions import counters
from floeline.operators.quantiles import exact_quantiles


def class_camera_rollup(detections: DataFrame) -> DataFrame:
    """The workload that the scaling experiment times."""
    return detections.groupBy("cam_id", "class_name").agg(
        F.sum("area_pixels").alias("sum_area_pixels"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("ice_conc").alias("avg_ice_conc"),
    )


def join_trials(*parts: DataFrame) -> DataFrame:
    """Trials of several worker counts as one ordered table."""
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part)
    return joined.orderBy("executors", "rows", "trial")


def trial_summary(trials: DataFrame) -> DataFrame:
    """Per size and worker count; the deviation of a single run is 0."""
    keys = ["rows", "executors"]
    plain = trials.groupBy(*keys).agg(
        F.count("time_s").alias("runs"),
        F.avg("time_s").alias("time_mean_s"),
        F.coalesce(F.stddev_samp("time_s"), F.lit(0.0)).alias("time_std_s"),
        F.min("time_s").alias("time_min_s"),
        F.max("time_s").alias("time_max_s"),
    )
    medians = exact_quantiles(trials, keys, "time_s", {"time_median_s": 0.5}).drop("n")
    return plain.join(medians, keys).orderBy("executors", "rows")


def speedup_pivot(summary: DataFrame, workers: list[int]) -> DataFrame:
    """Median of the first worker count divided by each other one, per size."""
    wide = summary.groupBy("rows").pivot("executors", workers).agg(F.first("time_median_s"))
    base = F.col(f"`{workers[0]}`")
    return wide.select(
        "rows", *[F.try_divide(base, F.col(f"`{w}`")).alias(f"speedup_{w}") for w in workers[1:]]
    ).orderBy("rows")


def linearity(summary: DataFrame) -> DataFrame:
    """Fit of median time over size per worker count."""
    x = F.col("rows").cast("double")
    return (
        summary.groupBy("executors")
        .agg(
            F.regr_r2("time_median_s", x).alias("r2"),
            F.regr_slope("time_median_s", x).alias("seconds_per_row"),
        )
        .orderBy("executors")
    )


def latency_summary(
    trials: DataFrame, published: DataFrame | None = None, latencies: dict[str, str] | None = None
) -> DataFrame:
    """Median and 95th percentile of each latency by camera count.

    `published` (camera_count, published_measured, window_sec) is not in the trials; with it come
    drop rate and throughput. `latencies` maps a column prefix to a trial column.
    """
    latencies = latencies or {
        "end_to_end": "worker_processing_ms",
        "delivery": "collector_delivery_ms",
        "inference": "inference_ms",
    }
    out = trials.groupBy("camera_count").agg(F.count(F.lit(1)).alias("processed_measured"))
    measures = [F.col(column).cast("double").alias(prefix) for prefix, column in latencies.items()]
    long = trials.select("camera_count", *measures).unpivot("camera_count", list(latencies), "measure", "ms")
    found = exact_quantiles(long, ["camera_count", "measure"], "ms", {"median": 0.5, "p95": 0.95})
    wide = found.groupBy("camera_count").agg(
        *[
            F.max(F.when(F.col("measure") == prefix, F.col(tag))).alias(f"{prefix}_{tag}_ms")
            for prefix in latencies
            for tag in ("median", "p95")
        ]
    )
    out = out.join(wide, "camera_count", "left")
    if published is not None:
        processed, sent = F.col("processed_measured"), F.col("published_measured")
        out = out.join(published, "camera_count", "left").withColumns(
            {
                "drop_rate": F.greatest(F.lit(0.0), 1 - F.try_divide(processed, sent)),
                "throughput_fps": F.try_divide(processed, F.col("window_sec")),
            }
        )
    return out


def distinct_frames(trials: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """Deliveries against distinct frames; the drop rate ignores redelivered copies."""
    out = trials.groupBy("camera_count").agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.count_distinct(F.struct("cam_id", "frame_seq")).alias("distinct_frames"),
    )
    if published is not None:
        share = F.try_divide(F.col("distinct_frames"), F.col("published_measured"))
        out = out.join(published, "camera_count", "left").withColumn(
            "drop_rate", F.greatest(F.lit(0.0), 1 - share)
        )
    return out


def shuffled(trials: DataFrame, seed: int = 42, index: Column | None = None) -> DataFrame:
    """Trials in a seeded random order, which is kept in `run_order_key`.

    The order is a permutation of `index`, a whole number of 0 or more that tells the trials apart; without
    one it follows from the content of a row.
    """
    if index is None:
        index = F.xxhash64(*trials.columns).bitwiseAND(F.lit(2**62 - 1))
    return counters.permuted(trials, index, seed, "run_order_key").orderBy("run_order_key")
