"""Queue totals on a stream: arrivals per queue so far, with a flag at the limits.

The running counts are a streaming aggregation (partial aggregation before the
shuffle, one small state row per queue), emitted in update mode. The snapshot
sink appends each micro-batch's updated rows with the batch id, so the latest
total per queue is a latest-wins read, and a replayed batch writes the same
rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowspark.functions.parse import data_size_bytes
from flowspark.streaming.io import with_trigger


def queue_depth_stream(df: DataFrame, queue: str, size: str | Column,
                       max_objects: int | str = 10000, max_bytes: int | str = "1 GB") -> DataFrame:
    """Streaming: objects and bytes seen per queue so far, ``limit_reached`` once
    either limit is (use output mode "update")."""
    limit = max_bytes if isinstance(max_bytes, int) else data_size_bytes(max_bytes)
    if limit is None:
        raise ValueError(f"not a data size: {max_bytes!r}")
    sz = (F.col(size) if isinstance(size, str) else size).cast("bigint")
    agg = df.groupBy(F.col(queue).alias("queue")).agg(
        F.count(F.lit(1)).alias("total_objects"), F.coalesce(F.sum(sz), F.lit(0)).alias("total_bytes"))
    return agg.withColumn("limit_reached", (F.col("total_objects") >= int(max_objects))
                          | (F.col("total_bytes") >= limit))


def start_snapshot_sink(df: DataFrame, path: str, checkpoint: str, name: str | None = None,
                        period: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Append each micro-batch's updated rows with its batch id (update mode)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(path)

    w = (df.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    if name:
        w = w.queryName(name)
    return with_trigger(w, period, available_now).start()


def latest_snapshot(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """The last row of each key in a snapshot folder: what the last batch that
    updated it wrote. After a bounded run it also holds what was still open."""
    snap = spark.read.parquet(path)
    values = [c for c in snap.columns if c not in (*keys, "batch_id")]
    best = F.max_by(F.struct(*values), F.col("batch_id"))
    return snap.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def latest_depth(spark: SparkSession, path: str) -> DataFrame:
    """The current totals per queue."""
    return latest_snapshot(spark, path, "queue")
