"""Streaming alert: sliding-window counts closed by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP. A TIMESTAMP_NTZ column becomes the instant
    whose UTC wall clock it is, so windows align to its own wall clock in any
    session time zone (a plain cast would go through the session zone)."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        us = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
        return df.withColumn(ts, F.timestamp_micros(us))
    return df


def wall_clock(c: Column) -> Column:
    """Inverse of ``event_time`` for NTZ input: the instant's UTC wall clock as
    TIMESTAMP_NTZ, without consulting the session time zone."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(F.unix_micros(c).cast("decimal(38,0)") / 1_000_000).cast("decimal(18,6)"))


def sliding_counts(df: DataFrame, key: str, ts: str, window: str, slide: str, delay: str) -> DataFrame:
    """Rows per window (length ``window``, every ``slide``) and key. State is
    bounded by the watermark (max event time − ``delay``). In append mode a
    window is emitted once, when the watermark passes its end; in update mode
    with its count so far, also while it is open."""
    s = event_time(df, ts).withWatermark(ts, delay)
    agg = s.groupBy(F.window(F.col(ts), window, slide).alias("w"), F.col(key)).agg(
        F.count(F.lit(1)).alias("n_events"))
    return agg.select(wall_clock(F.col("w.start")).alias("window_start"),
                      wall_clock(F.col("w.end")).alias("window_end"), key, "n_events")


def sliding_alert(df: DataFrame, key: str, ts: str, window: str, slide: str, delay: str,
                  more_than: int) -> DataFrame:
    """The windows of ``sliding_counts`` with more than ``more_than`` rows."""
    return sliding_counts(df, key, ts, window, slide, delay).filter(F.col("n_events") > more_than)


def error_counts_stream(df: DataFrame, ts: str, is_error, period: str, delay: str) -> DataFrame:
    """Events and errors per fixed period: in append mode each period once the
    watermark (max event time − ``delay``) has passed its end, in update mode its
    counts so far. The stored periods feed the batch ``rate_spikes`` comparison;
    the state is one row per open period."""
    s = event_time(df, ts).withWatermark(ts, delay)
    err = F.coalesce(is_error, F.lit(False))
    agg = s.groupBy(F.window(F.col(ts), period).alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(err).alias("n_errors"))
    return agg.select(wall_clock(F.col("w.start")).alias("period_start"),
                      wall_clock(F.col("w.end")).alias("period_end"), "n_events", "n_errors")
