"""Connection-queue settings as table operators: expiry, back-pressure, priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.parse import data_size_bytes, duration_ms
from flowspark.functions.text import now_column
from flowspark.operators.prefix import running_totals
from flowspark.records import CREATED_AT, SIZE


def expire(df: DataFrame, ttl: str, ts: str = CREATED_AT, now: str | Column | None = None) -> DataFrame:
    """Drop records older than ``ttl`` at ``now``; '0 sec' means never expire."""
    ms = duration_ms(ttl)
    if ms is None:
        raise ValueError(f"not a duration: {ttl!r}")
    if ms == 0:
        return df
    cutoff = now_column(now) - F.make_dt_interval(secs=F.lit(ms / 1000.0).cast("decimal(18,6)"))
    return df.filter(F.col(ts) >= cutoff)


def queue_pressure(df: DataFrame, queue: str, order: Sequence[str], size: str | Column = SIZE,
                   max_objects: int | str = 10000, max_bytes: int | str = "1 GB") -> DataFrame:
    """Objects and bytes that have arrived per queue so far, in arrival order, and
    ``limit_reached`` from the arrival that reaches either limit on. These are
    totals of arrivals (nothing leaves). Parallel for a hot queue."""
    objs = int(max_objects)
    limit = max_bytes if isinstance(max_bytes, int) else data_size_bytes(max_bytes)
    if limit is None:
        raise ValueError(f"not a data size: {max_bytes!r}")
    out = running_totals(df, [queue], list(order),
                         {"total_objects": F.lit(1).cast("bigint"),
                          "total_bytes": (F.col(size) if isinstance(size, str) else size).cast("bigint")})
    return out.withColumn("limit_reached", (F.col("total_objects") >= objs) |
                          (F.col("total_bytes") >= limit))


def prioritize(df: DataFrame, *cols: str | Column) -> DataFrame:
    """Order at a batch boundary; no prioritizer means no sort (and no shuffle)."""
    return df.orderBy(*cols) if cols else df
