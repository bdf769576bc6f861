"""Run handle for a flow's streaming queries: start / stop / list / summary.

No scheduler of its own: each sink is one named ``StreamingQuery``; starting
is idempotent by name, and the outcome lists have the started /
already_running / failed shape of a run summary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


class FlowRunner:
    def __init__(self, spark: SparkSession, flow_name: str = "flow"):
        self.spark = spark
        self.flow_name = flow_name
        self.starters: dict[str, Callable[[str], StreamingQuery]] = {}
        self.queries: dict[str, StreamingQuery] = {}  # the last query started of each sink
        self.errors: dict[str, str] = {}              # why the last action on a sink failed

    def qname(self, sink: str) -> str:
        return f"{self.flow_name}.{sink}"

    def register(self, sink: str, starter: Callable[[str], StreamingQuery]) -> FlowRunner:
        """``starter(query_name)`` builds and starts the sink's query."""
        self.starters[sink] = starter
        return self

    def active(self) -> dict[str, StreamingQuery]:
        prefix = self.flow_name + "."
        return {q.name[len(prefix):]: q for q in self.spark.streams.active
                if q.name and q.name.startswith(prefix)}

    def _each(self, sinks: tuple[str, ...], done: str, already: str, want_active: bool,
              act: Callable[[str], object]) -> dict[str, list[str]]:
        """Act on the sinks that are not in the wanted state; a failure is listed and its reason kept."""
        out: dict[str, list[str]] = {done: [], already: [], "failed": []}
        running = self.active()
        for s in sinks or tuple(self.starters):
            if (s in running and running[s].isActive) == want_active:
                out[already].append(s)
                continue
            try:
                act(s)
                self.errors.pop(s, None)
                out[done].append(s)
            except Exception as e:  # noqa: BLE001 - reported in the summary, as the caller asked
                self.errors[s] = f"{type(e).__name__}: {e}"
                out["failed"].append(s)
        return {k: sorted(v) for k, v in out.items()}

    def start(self, *sinks: str) -> dict[str, list[str]]:
        def go(s: str) -> None:
            self.queries[s] = self.starters[s](self.qname(s))
        return self._each(sinks, "started", "already_running", True, go)

    def stop(self, *sinks: str) -> dict[str, list[str]]:
        return self._each(sinks, "stopped", "already_stopped", False, lambda s: self.active()[s].stop())

    def await_all(self, timeout_s: float | None = None) -> None:
        """Wait for the flow's running queries (available-now runs) to finish."""
        from flowspark.streaming.io import run_to_end
        for q in self.active().values():
            run_to_end(q, timeout_s)

    def status(self) -> list[dict]:
        """One row per registered sink: state (RUNNING, STOPPED, or FAILED with the
        reason in ``error``), id, last batch and its counters."""
        running = self.active()
        rows = []
        for s in sorted(self.starters):
            q = running.get(s)
            p = q.lastProgress if q is not None else None
            crash = self.queries[s].exception() if s in self.queries else None
            error = str(crash) if crash is not None else self.errors.get(s)
            state = "RUNNING" if q is not None and q.isActive else "FAILED" if error else "STOPPED"
            rows.append({
                "name": s, "state": state, "error": error if state == "FAILED" else None,
                "id": str(q.id) if q is not None else None,
                "batch_id": p["batchId"] if p else None,
                "input_rows": p["numInputRows"] if p else None,
                "observed": p.get("observedMetrics") if p else None,
            })
        return rows


def shared_runner(spark: SparkSession, flow, staging: str, sinks: dict[str, dict] | None = None, period: str | None = None,
                  available_now: bool = False, checkpoint_root: str | None = None,
                  merge_every: int | None = None) -> FlowRunner:
    """Runner with one query, ``all``, for every sink of the flow (``streaming.shared.start_shared``)."""
    from flowspark.session import stable_dir
    from flowspark.streaming.shared import start_shared

    cp = (f"{checkpoint_root.rstrip('/')}/{flow.name}/all" if checkpoint_root
          else stable_dir(spark, "checkpoints", flow.name, "all"))
    return FlowRunner(spark, flow.name).register("all", lambda qname: start_shared(
        flow, spark, staging, cp, sinks, merge_every, qname, period, available_now))


def flow_runner(spark: SparkSession, flow, sinks: dict[str, dict] | None = None, period: str | None = None,
                available_now: bool = False, checkpoint_root: str | None = None) -> FlowRunner:
    """Runner for a flow whose sources are streams: one query per terminal stage,
    the replace store for a ``store`` stage, a file sink for those in ``sinks`` (``{stage: {"path": ..., "partition_by": [...],
    "format": "parquet"}}``; ``"format": "text"`` writes the ``line`` column as a log). Checkpoints live at a fixed place per (flow,
    stage), so a restart resumes where the last run committed."""
    from flowspark.session import stable_dir
    from flowspark.streaming.io import start_file_sink, store_stream

    runner = FlowRunner(spark, flow.name)
    stores = {n: st.props for n, st in flow.stages.items() if st.type == "store"}
    for stage, spec in {**stores, **(sinks or {})}.items():
        cp = (f"{checkpoint_root.rstrip('/')}/{flow.name}/{stage}" if checkpoint_root
              else stable_dir(spark, "checkpoints", flow.name, stage))

        def starter(qname: str, stage=stage, spec=spec, cp=cp) -> StreamingQuery:
            df = flow.plan(spark)[stage]
            if spec is stores.get(stage):
                return store_stream(df, spec["path"], spec.get("by", "category"), spec.get("filename", "filename"),
                                    cp, order=spec.get("order", ("created_at", "record_id")), name=qname,
                                    period=period, available_now=available_now)
            if spec.get("format") == "text":  # a log file: one text column per row
                df = df.select(spec.get("column", "line"))
            return start_file_sink(df, spec["path"], cp, spec.get("partition_by", ()),
                                   spec.get("format", "parquet"), name=qname, period=period,
                                   available_now=available_now)
        runner.register(stage, starter)
    return runner
