"""Record generator: ``batch_size`` records of ``file_size`` bytes per firing.

A firing is a row of a driving table (id, time), so a batch job generates from
a schedule or any table, and a stream generates one batch per trigger. Content
is deterministic: custom text wins over the size; otherwise hex text of an
SHA-256 chain seeded by the record id, cut to exactly ``file_size`` bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.parse import data_size_bytes, duration_ms
from flowspark.records import ATTRIBUTES, CONTENT, CREATED_AT, RECORD_ID, SIZE, content_size


def filler(seed: Column, n_bytes: int) -> Column:
    """Exactly ``n_bytes`` ASCII bytes, a pure function of ``seed``."""
    if n_bytes <= 0:
        return F.lit("")
    reps = -(-n_bytes // 64)
    return F.substr(F.repeat(F.sha2(seed, 256), F.lit(reps)), F.lit(1), F.lit(n_bytes))


def generate_records(firings: DataFrame, firing_id: str, fired_at: str, batch_size: int = 1,
                     file_size: str = "1KB", custom_text: str | None = None) -> DataFrame:
    """Record envelope rows, ``batch_size`` per firing (a narrow Generate)."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    n_bytes = data_size_bytes(file_size)
    if n_bytes is None:
        raise ValueError(f"not a data size: {file_size!r}")
    idx = F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))).alias("__i")
    rows = firings.select(F.col(firing_id).alias("__f"), F.col(fired_at).alias(CREATED_AT), idx)
    rid = F.concat(F.col("__f").cast("string"), F.lit("-"), F.col("__i").cast("string"))
    body = F.lit(custom_text) if custom_text is not None else filler(rid, n_bytes)
    return rows.select(
        rid.alias(RECORD_ID), CREATED_AT,
        F.create_map(F.lit("filename"), rid).alias(ATTRIBUTES),
        body.alias(CONTENT)).withColumn(SIZE, content_size(CONTENT))


def schedule(spark: SparkSession, firings: int, period: str = "60 sec",
             start: str = "2024-01-01 00:00:00") -> DataFrame:
    """Batch firings ``0..n-1`` at ``start + i * period`` (TIMESTAMP_NTZ)."""
    ms = duration_ms(period)
    if ms is None:
        raise ValueError(f"not a duration: {period!r}")
    t0 = F.lit(start).cast("timestamp_ntz")
    return spark.range(firings).select(
        F.col("id").alias("firing_id"),
        (t0 + F.make_dt_interval(secs=(F.col("id") * F.lit(ms) / 1000).cast("decimal(18,6)")))
        .alias("fired_at"))


def schedule_stream(spark: SparkSession, batch_size: int = 1, period: str = "60 sec",
                    start_ms: int = 1704067200000) -> DataFrame:
    """Streaming firings: one micro-batch = one firing of ``batch_size`` rows,
    event time advancing ``period`` per batch (deterministic, restart-safe)."""
    ms = duration_ms(period)
    if not ms:
        raise ValueError(f"not a positive duration: {period!r}")
    src = (spark.readStream.format("rate-micro-batch")
           .option("rowsPerBatch", batch_size).option("advanceMillisPerBatch", ms)
           .option("startTimestamp", start_ms).load())
    return src.select(F.col("value").alias("firing_id"), F.col("timestamp").alias("fired_at"))


def generate_stream(spark: SparkSession, batch_size: int = 1, file_size: str = "1KB",
                    custom_text: str | None = None, period: str = "60 sec",
                    start_ms: int = 1704067200000) -> DataFrame:
    """Scheduled generator as a stream (one record per row of the rate source)."""
    return generate_records(schedule_stream(spark, batch_size, period, start_ms),
                            "firing_id", "fired_at", 1, file_size, custom_text)
