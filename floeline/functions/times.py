"""Time expressions. Every clock-dependent one takes the current time as an argument."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from floeline import schemas


def event_time(epoch: Column, grain: str = "micro") -> Column:
    """Epoch seconds to a timestamp; `grain='second'` drops the fraction."""
    if grain == "second":
        return F.date_trunc("second", epoch.try_cast("timestamp"))
    if grain != "micro":
        raise ValueError(f"unknown grain: {grain}")
    return epoch.try_cast("timestamp")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return micros(ts) / F.lit(1e6)


def hour_start(df: DataFrame, name: str) -> Column:
    """Start of the hour, in the type of the column (`date_trunc` would turn NTZ into TIMESTAMP)."""
    return F.date_trunc("hour", F.col(name)).cast(df.schema[name].dataType)


def parse_text_time(text: Column) -> Column:
    """Digits are epoch seconds, ISO text (with Z or offset) is a time, anything else NULL."""
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), trimmed.try_cast("double"))
    iso = F.when(
        trimmed.rlike(
            r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
            r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"
        ),
        trimmed.try_cast("timestamp"),
    )
    return F.coalesce(number.try_cast("timestamp"), iso)


def parse_epoch(value: Column) -> Column:
    """Numeric input: zero means no time."""
    return F.when(value != 0, value.cast("double").try_cast("timestamp"))


def wall_clock(ts: Column, zone: str = schemas.DISPLAY_ZONE_ID, missing: str = schemas.NO_TIME_TEXT) -> Column:
    """HH:mm:ss in a fixed zone."""
    local = F.convert_timezone(None, F.lit(zone), ts.cast("timestamp"))
    return F.coalesce(F.date_format(local, "HH:mm:ss"), F.lit(missing))


def lag_seconds(as_of: Column, ts: Column) -> Column:
    """Seconds since `ts`, never negative, NULL without a time."""
    gap = (micros(as_of) - micros(ts)) / F.lit(1e6)
    return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))


def freshness(age_sec: Column, half_life: float = schemas.HALF_LIFE_SEC) -> Column:
    """Halves every `half_life` seconds; 1 before the first result."""
    return F.coalesce(F.pow(F.lit(0.5), age_sec / half_life), F.lit(1.0))


def queue_age_ms(processed: Column, source: Column) -> Column:
    return F.round((processed - source) * 1000.0, 3)


def mask_lag_sec(frame_ts: Column, result_source_ts: Column) -> Column:
    gap = frame_ts - result_source_ts
    return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))


def mask_is_fresh(age_sec: Column, max_age: float = schemas.MASK_MAX_AGE_SEC) -> Column:
    return F.coalesce(age_sec <= max_age, F.lit(False))


def is_ntz(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)
