"""Alert rules over time: threshold in a trailing period, error-rate spike, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.parse import duration_ms
from flowspark.functions.text import now_column
from flowspark.operators.prefix import running_totals


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since 1970 without any time-zone shift for TIMESTAMP_NTZ."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return F.unix_micros(F.col(ts))


def _period_start(df: DataFrame, ts: str, ms: int) -> Column:
    """Start of the fixed period (aligned to 1970-01-01) holding ``ts``; null
    stays null. Time-zone free for TIMESTAMP_NTZ."""
    us = epoch_micros(df, ts)
    secs = (F.floor(us / F.lit(ms * 1000)) * F.lit(ms)).cast("decimal(38,3)") / 1000
    origin = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
              if isinstance(df.schema[ts].dataType, T.TimestampNTZType) else F.timestamp_seconds(F.lit(0)))
    return origin + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))


def _ms(period: str) -> int:
    ms = duration_ms(period)
    if not ms:
        raise ValueError(f"not a positive duration: {period!r}")
    return ms


def threshold_alert(df: DataFrame, key: str | None, ts: str, period: str, more_than: int,
                    count_name: str = "n_recent") -> DataFrame:
    """Rows whose trailing count in ``[ts - period, ts]`` (same key) exceeds ``more_than``.

    Equal to ``count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN period
    PRECEDING AND CURRENT ROW) > more_than``, without putting a key in one task.
    The count is the same for all rows of a key and time, so these are counted
    first (a burst collapses before the shuffle). It is ``C(<= t) - C(< t -
    period)``, with ``C`` the running count in time order: each (key, time) gives
    its own count and one probe at ``t - period``, which comes before equal times;
    the skew-safe ``running_totals`` answers both, and the rows take the counts
    above the limit by an equi-join on key and time, which AQE splits where a
    burst is hot. Rows without a time are each other's peers.
    """
    p_us = _ms(period) * 1000
    k = F.col(key) if key else F.lit(None).cast("int")
    times = df.groupBy(k.alias("k"), epoch_micros(df, ts).alias("us")).agg(F.count(F.lit(1)).alias("n"))
    probe = F.explode(F.array(F.lit(False), F.lit(True))).alias("own")
    probes = times.select("k", "us", "n", probe).select(
        "k", F.when(F.col("own"), F.col("us")).otherwise(F.col("us") - F.lit(p_us)).alias("at"), "own", "us",
        F.when(F.col("own"), F.col("n")).otherwise(F.lit(0)).alias("n"))
    run = running_totals(probes, ["k"] if key else [], ["at", "own"], {"c": "n"})
    counts = (run.groupBy("k", "us").agg(F.sum(F.when(F.col("own"), F.col("c")).otherwise(-F.col("c"))).alias("n"))
              .filter(F.col("n") > more_than))
    names = {"k": "__k", "us": "__us", "n": "__n"}
    while set(names.values()) & set(df.columns):
        names = {c: f"{v}_" for c, v in names.items()}
    counts = counts.withColumnsRenamed(names)
    same = epoch_micros(df, ts).eqNullSafe(F.col(names["us"]))
    if key:
        same = same & F.col(key).eqNullSafe(F.col(names["k"]))
    return df.join(counts, same).select(*df.columns, F.col(names["n"]).alias(count_name))


def error_rate_spike(df: DataFrame, ts: str, is_error: Column, period: str = "1 hour",
                     lookback: int = 3, limit: float = 0.05) -> DataFrame:
    """Per period: events, errors, error rate, pooled rate of the ``lookback``
    periods before it (by time; empty periods count as nothing) and ``is_spike``
    when the rate exceeds that trailing rate by more than ``limit``.

    One scan: the events collapse to one row per period (partial aggregation
    before the shuffle), and ``rate_spikes`` compares the periods on that
    small table. No window runs over all periods in one task.
    """
    return rate_spikes(period_counts(df, ts, is_error, period), period, lookback, limit)


def period_counts(df: DataFrame, ts: str, is_error: Column, period: str = "1 hour") -> DataFrame:
    """Events and errors per fixed period (aligned to 1970-01-01); a row without
    time falls in the null period."""
    start = _period_start(df, ts, _ms(period))
    return df.groupBy(start.alias("period_start")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.coalesce(is_error, F.lit(False))).alias("n_errors"))


def rate_spikes(counts: DataFrame, period: str = "1 hour", lookback: int = 3,
                limit: float = 0.05, start: str = "period_start") -> DataFrame:
    """``error_rate_spike`` over a table of period counts (``start``,
    ``n_events``, ``n_errors``), e.g. the stored output of the streaming
    ``error_counts_stream``. Each period row also counts as prior for the next
    ``lookback`` periods; one aggregate, no window over all periods."""
    ms = _ms(period)
    last = F.when(F.col(start).isNull(), F.lit(0)).otherwise(F.lit(lookback))
    shifted = counts.select(F.col(start).alias("__p"), "n_events", "n_errors",
                            F.explode(F.sequence(F.lit(0), last)).alias("__j")).withColumn(
        "period_start", F.col("__p") + F.make_dt_interval(
            secs=(F.col("__j") * F.lit(ms / 1000.0)).cast("decimal(18,6)")))
    own, prior = F.col("__j") == 0, F.col("__j") > 0
    zero = F.lit(0).cast("bigint")
    out = (shifted.groupBy("period_start")
           .agg(F.sum(F.when(own, F.col("n_events")).otherwise(zero)).alias("n_events"),
                F.sum(F.when(own, F.col("n_errors")).otherwise(zero)).alias("n_errors"),
                F.sum(F.when(prior, F.col("n_events")).otherwise(zero)).alias("prior_events"),
                F.sum(F.when(prior, F.col("n_errors")).otherwise(zero)).alias("prior_errors"),
                F.max(own.cast("int")).alias("__has"))
           .filter(F.col("__has") == 1).drop("__has"))
    rate = F.col("n_errors") / F.nullif(F.col("n_events"), F.lit(0))
    trailing = F.col("prior_errors") / F.nullif(F.col("prior_events"), F.lit(0))
    return out.select(
        "period_start", "n_events", "n_errors", "prior_events", "prior_errors",
        F.round(rate, 6).alias("error_rate"), F.round(trailing, 6).alias("trailing_rate"),
        F.coalesce(rate > trailing + F.lit(limit), F.lit(False)).alias("is_spike"))


def expiry_warning(df: DataFrame, expires_at: str, within: str = "30 days",
                   now: str | Column | None = None) -> DataFrame:
    """Items expiring in ``[now, now + within]`` with whole days left."""
    n = now_column(now)
    horizon = n + F.make_dt_interval(secs=F.lit(_ms(within) / 1000.0).cast("decimal(18,6)"))
    return (df.filter((F.col(expires_at) >= n) & (F.col(expires_at) <= horizon))
            .withColumn("days_left", F.datediff(F.col(expires_at), n).cast("bigint")))


def older_than(ts: str | Column, age: str, now: str | Column | None = None) -> Column:
    """Flag: ``ts`` is more than ``age`` before ``now`` (e.g. an 8-hour token life)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return c < now_column(now) - F.make_dt_interval(secs=F.lit(_ms(age) / 1000.0).cast("decimal(18,6)"))
