"""Stream sources and sinks: tables as file streams, triggers, partitioned sinks."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from flowspark.functions.parse import data_size_bytes, trigger_interval


def stream_table(spark: SparkSession, root: str, name: str,
                 max_files_per_trigger: int | None = None,
                 max_bytes_per_trigger: int | str | None = None,
                 options: dict[str, str] | None = None) -> DataFrame:
    """A table folder (or a single ``name.parquet`` file) as a file stream."""
    return stream_path(spark, f"{root.rstrip('/')}/{name}.parquet", max_files_per_trigger,
                       max_bytes_per_trigger, options)


def stream_path(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                max_bytes_per_trigger: int | str | None = None,
                options: dict[str, str] | None = None) -> DataFrame:
    """Parquet folder (or single file) as a file stream, schema from the footers.

    ``max_files_per_trigger`` / ``max_bytes_per_trigger`` are the source-side
    back-pressure caps (objects / bytes per micro-batch); Spark accepts one.
    The byte cap may be given as text ('1 GB'). ``options`` go to the file
    source as they are, e.g. ``cleanSource`` / ``sourceArchiveDir`` or
    ``maxFileAge`` to keep the listing of a long-lived landing folder short.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).options(**(options or {}))
    if isinstance(max_bytes_per_trigger, str):
        max_bytes_per_trigger = data_size_bytes(max_bytes_per_trigger)
    if max_files_per_trigger and max_bytes_per_trigger:
        raise ValueError("choose one of max_files_per_trigger and max_bytes_per_trigger")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", int(max_bytes_per_trigger))
    local = "://" not in path or path.startswith("file:")
    if local and os.path.isfile(path.removeprefix("file:")):
        return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return reader.parquet(path)


def with_trigger(writer: DataStreamWriter, period: str | None = None,
                 available_now: bool = False) -> DataStreamWriter:
    """``period='60 sec'`` → fixed-interval trigger; ``available_now`` → drain and stop."""
    if available_now:
        return writer.trigger(availableNow=True)
    if period:
        return writer.trigger(processingTime=trigger_interval(period))
    return writer


def start_file_sink(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (),
                    fmt: str = "parquet", name: str | None = None, period: str | None = None,
                    available_now: bool = False) -> StreamingQuery:
    """Append-only file sink: exactly-once through its own commit log + checkpoint."""
    w = df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if name:
        w = w.queryName(name)
    return with_trigger(w, period, available_now).start(path)


def run_to_end(q: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Wait for an available-now query and surface its failure. A query still
    running after ``timeout_s`` is stopped and reported, never left behind."""
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"stream {q.name or q.id} still running after {timeout_s} s; stopped")
    if q.exception() is not None:
        raise q.exception()
    return q


def store_stream(df: DataFrame, root: str, by: str, filename: str, checkpoint: str,
                 order: Sequence[str] = ("created_at", "record_id"),
                 name: str | None = None, period: str | None = None,
                 available_now: bool = False,
                 after_batch: Callable[[int], None] | None = None) -> StreamingQuery:
    """Stream into the replace store: each micro-batch is collapsed to its
    latest version per (directory, filename) and appended; ``read_store``
    resolves across batches. A replayed batch appends the same versions again,
    which resolve to the same rows, so the sink is idempotent without ever
    overwriting stored files. Records without a directory or filename (the
    failure relationship) are dropped here."""
    from flowspark.operators.sinks import store

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch, root, by, filename, order=order)
        if after_batch is not None:  # e.g. metrics; runs before the batch commits
            after_batch(batch_id)

    return start_batches(df, write, checkpoint, name, period, available_now)


def start_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None,
                  period: str | None = None, available_now: bool = False, mode: str = "append") -> StreamingQuery:
    """Start ``df`` with ``write(batch, batch_id)`` per micro-batch. A batch may be run again with its id
    after a crash, so ``write`` must store it once however often it comes."""
    w = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    if name:
        w = w.queryName(name)
    return with_trigger(w, period, available_now).start()
