"""Alerts on a stream as their rules say: per event and period, not per window step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowspark.functions.parse import duration_ms
from flowspark.streaming.alerts import event_time, wall_clock

HEARTBEAT = "beat_at timestamp"
SPAN_US = 24 * 3600 * 1_000_000


def trailing_counts(df: DataFrame, key: str, ts: str, event_id: str, period: str, delay: str) -> DataFrame:
    """Streaming: (key, event_id, ts, n_recent) with the exact count of the key's events in ``[ts - period, ts]``.

    Use output mode "update": an event's count goes out when the event comes, and
    again if an event that came later, but is not later than the watermark (the
    greatest time seen less ``delay``), falls into its period; the last row of each
    event counts (``latest_snapshot``). Spark has no built-in operator that counts
    from every event backwards, so this is keyed state with event-time timers,
    which runs Python workers on Arrow batches.

    A key's events are dealt by time into spans of a day, or of a period if that is longer, so that a key
    with most of the events is many groups. An event less than a period before its span's end goes to
    the next span too, where it is counted and not reported.

    State per key and span: the times back to the watermark less the period, and the ids of
    events after the watermark, whose counts may still change. A timer drops
    the state of a span that went quiet. Events with a null time, or behind the
    watermark, are dropped, as windows drop them; repeated ids count each time.
    """
    period_us, delay_us = (duration_ms(x) * 1000 for x in (period, delay))
    span_us = max(period_us, SPAN_US)
    ntz = isinstance(df.schema[ts].dataType, T.TimestampNTZType)
    kind, id_kind = (df.schema[c].dataType.simpleString() for c in (key, event_id))
    src = event_time(df.select(key, event_id, ts), ts).filter(F.col(ts).isNotNull())
    src = src.select(F.col(key).alias("k"), F.col(event_id).alias("e"), F.col(ts).alias("t"),
                     F.unix_micros(ts).alias("us")).withWatermark("t", f"{delay_us} microseconds")
    first, last = (F.floor((F.col("us") + x) / span_us) for x in (F.lit(0), F.lit(period_us)))
    src = src.withColumn("own", first).withColumn("span", F.explode(F.sequence(first, last)))

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, open_us, open_ids, told = state.get if state.exists else (b"", b"", [], b"")
        times, open_us, told = (np.frombuffer(x, np.int64) for x in (times, open_us, told))
        floor = state.getCurrentWatermarkMs() * 1000
        if state.hasTimedOut:
            new_us = own_us = np.zeros(0, np.int64)
            new_ids = []
        else:
            rows = pd.concat(list(frames))
            rows = rows[rows["us"] >= floor]
            new_us = rows["us"].to_numpy()
            rows = rows[rows["own"] == k[1]]
            own_us, new_ids = rows["us"].to_numpy(), rows["e"].tolist()
        every = np.sort(np.concatenate([times, new_us]))
        us = np.concatenate([open_us, own_us])
        ids = np.empty(len(us), dtype=object)
        ids[:] = [*open_ids, *new_ids]
        n = np.searchsorted(every, us, side="right") - np.searchsorted(every, us - period_us, side="left")
        changed = n != np.concatenate([told, np.full(len(own_us), -1)])
        yield pd.DataFrame({"k": pd.Series([k[0]] * int(changed.sum()), dtype=object),
                            "e": pd.Series(ids[changed], dtype=object), "us": us[changed], "n": n[changed]})
        keep = us >= floor
        kept = every[every >= floor - period_us]
        if len(kept):
            state.update((kept.tobytes(), us[keep].tobytes(), ids[keep].tolist(), n[keep].tobytes()))
            # nothing of this span matters once the watermark is past its last time and the period after it
            state.setTimeoutTimestamp(max(floor // 1000 + 1, (int(kept[-1]) + period_us) // 1000 + 1))
        else:
            state.remove()

    out = src.groupBy("k", "span").applyInPandasWithState(
        update, f"k {kind}, e {id_kind}, us bigint, n bigint",
        f"times binary, open_us binary, open_ids array<{id_kind}>, told binary",
        "update", GroupStateTimeout.EventTimeTimeout)
    at = F.timestamp_micros("us")
    return out.select(F.col("k").alias(key), F.col("e").alias(event_id), (wall_clock(at) if ntz else at).alias(ts),
                      F.col("n").alias("n_recent"))


def with_heartbeats(df: DataFrame, ts: str, folder: str) -> DataFrame:
    """``df`` (streaming, ``ts`` as TIMESTAMP) and the heartbeats that ``beat`` writes to ``folder``.

    A heartbeat is a row with a time and nulls else: it moves the watermark of a
    source that went quiet, so that its last windows close. The column
    ``is_beat`` tells them apart.
    """
    beats = df.sparkSession.readStream.schema(HEARTBEAT).parquet(folder)
    others = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != ts else F.col("beat_at").alias(ts)
              for f in df.schema.fields]
    return df.withColumn("is_beat", F.lit(False)).unionByName(beats.select(*others, F.lit(True).alias("is_beat")))


def beat(spark: SparkSession, folder: str, at: str | None = None) -> None:
    """Write one heartbeat at a time (UTC wall clock); None only makes the folder."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', "
                f"TIMESTAMP_NTZ'{at or '1970-01-01 00:00:00'}')")
    rows = spark.range(1).select(F.timestamp_micros(us).alias("beat_at"))
    (rows if at else rows.limit(0)).write.mode("append").parquet(folder)


def error_spike_stream(df: DataFrame, ts: str, is_error: Column, period: str = "1 hour", lookback: int = 3,
                       limit: float = 0.05, delay: str = "30 minutes", beats: str | None = None) -> DataFrame:
    """Streaming ``error_rate_spike``: per period its error rate, the pooled rate of the ``lookback`` periods
    before it, and whether it exceeds that by more than ``limit``; each period once, in append mode.

    Two chained event-time aggregates in one query: periods are counted when the
    watermark closes them, and their counts feed a window over ``lookback`` + 1
    periods that slides by one, whose last period is compared with the others.
    State: a row per open period and open window. ``beats`` is the folder of heartbeats
    (``beat``) that close the last periods of a source that has ended.
    Events without a time are dropped.
    """
    ms = duration_ms(period)
    length = F.make_dt_interval(secs=F.lit(ms / 1000.0).cast("decimal(18,6)"))
    ntz = isinstance(df.schema[ts].dataType, T.TimestampNTZType)
    s = event_time(df.select(ts, F.coalesce(is_error, F.lit(False)).alias("err")), ts)
    s = with_heartbeats(s, ts, beats) if beats else s.withColumn("is_beat", F.lit(False))
    own = (s.withWatermark(ts, delay).groupBy(F.window(ts, f"{ms} milliseconds").alias("w"))
           .agg(F.count_if(~F.col("is_beat")).alias("n"), F.count_if(F.col("err") & ~F.col("is_beat")).alias("bad")))
    zero = F.lit(0).cast("bigint")
    out = (own.select(F.col("w.start").alias("start"), F.window_time("w").alias("at"), "n", "bad")
           .groupBy(F.window("at", f"{ms * (lookback + 1)} milliseconds", f"{ms} milliseconds").alias("v")))
    out = out.agg(F.max_by(F.struct("start", "n", "bad"), F.col("start")).alias("own"),
                  F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    mine = F.col("own.start") == F.col("v.end") - length
    rows = out.filter(mine & (F.col("own.n") > 0)).select(
        F.col("own.start").alias("start"), F.col("own.n").alias("n_events"), F.col("own.bad").alias("n_errors"),
        (F.col("all_n") - F.col("own.n")).alias("prior_events"), (F.col("all_bad") - F.col("own.bad")).alias("prior_errors"))
    rate = F.col("n_errors") / F.nullif(F.col("n_events"), zero)
    trailing = F.col("prior_errors") / F.nullif(F.col("prior_events"), zero)
    return rows.select((wall_clock(F.col("start")) if ntz else F.col("start")).alias("period_start"), "n_events", "n_errors",
                       "prior_events", "prior_errors", F.round(rate, 6).alias("error_rate"),
                       F.round(trailing, 6).alias("trailing_rate"),
                       F.coalesce(rate > trailing + F.lit(limit), F.lit(False)).alias("is_spike"))
