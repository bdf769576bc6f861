"""One streaming query for all sinks of a flow: its source is read once per micro-batch.

A streaming query per sink reads the source once per sink. Here the source
feeds one query, and each micro-batch runs through the whole flow as a batch: what
several branches need is staged once (``Flow.plan``), and every sink writes under
its own name and the batch's id. A micro-batch that is run again after a crash
overwrites its staging and file folders, and the stores know it (``GenerationStore``),
so each sink holds it once, although the sinks commit one after the other.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flowspark.operators.generations import GenerationStore
from flowspark.plans.flow import STAGE_TYPES, Flow, Stage
from flowspark.streaming.io import start_batches


def _source(flow: Flow, spark: SparkSession) -> tuple[str, DataFrame]:
    """The flow's streaming source stage and its frame; other sources may be batch tables."""
    found = []
    for name, st in flow.stages.items():
        if STAGE_TYPES[st.type].source:
            df = STAGE_TYPES[st.type].fn(spark, **st.props)
            if df.isStreaming:
                found.append((name, df))
    if len(found) != 1:
        raise ValueError(f"a shared run needs one streaming source; {flow.name} has {[n for n, _ in found]}")
    return found[0]


def store_of(spark: SparkSession, flow: Flow, stage: str) -> GenerationStore:
    """The generation store that a ``store`` stage of a shared run writes to."""
    props = flow.stages[stage].props
    return GenerationStore(spark, props["path"], props.get("by", "category"), props.get("filename", "filename"),
                           tuple(props.get("order", ("created_at", "record_id"))))


def start_shared(flow: Flow, spark: SparkSession, staging: str, checkpoint: str, sinks: dict[str, dict] | None = None,
                 merge_every: int | None = None, name: str | None = None, period: str | None = None,
                 available_now: bool = False) -> StreamingQuery:
    """Start the flow as one query. ``sinks``: a folder per terminal stage that is not a store,
    ``{stage: {"path": ..., "format": "parquet", "partition_by": [...]}}``; rows of micro-batch n are
    in its sub-folder ``batch=n`` (a ``text`` sink writes the ``line`` column). Every terminal stage needs a place.

    ``staging`` is a shared scratch folder; micro-batch n leaves its staged rows in ``batch=n`` there until
    the caller removes them.
    """
    at, source = _source(flow, spark)
    ends = {n for n in flow.stages if not any(e.source == n for e in flow.edges)}
    stores = {n for n in ends if flow.stages[n].type == "store"}
    loose = sorted(ends - stores - set(sinks or {}))
    if loose:
        raise ValueError(f"terminal stages without a sink: {loose}")

    def write(batch: DataFrame, batch_id: int) -> None:
        stages = flow.stages | {at: Stage(at, "table", {"frame": batch}, flow.stages[at].auto_terminate)}
        run = dataclasses.replace(flow, stages=stages)
        for end, df in run.plan(batch.sparkSession, f"{staging.rstrip('/')}/batch={batch_id}").items():
            if end in stores:
                store_of(batch.sparkSession, flow, end).sink(f"{flow.name}-{end}", merge_every)(df, batch_id)
                continue
            spec = sinks[end]
            if spec.get("format") == "text":
                df = df.select(spec.get("column", "line"))
            w = df.write.mode("overwrite").format(spec.get("format", "parquet"))
            if spec.get("partition_by"):
                w = w.partitionBy(*spec["partition_by"])
            w.save(f"{spec['path'].rstrip('/')}/batch={batch_id}")

    return start_batches(source, write, checkpoint, name, period, available_now)
