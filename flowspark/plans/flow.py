"""Flows: named stages connected by relationships, compiled to lazy DataFrames.

A stage type is a function registered by name: sources take the session,
others take the incoming DataFrame; both take the stage's properties. An edge
selects relationships of its source stage; several edges into one stage are
a fan-in (UNION ALL by name). ``plan()`` walks the graph in topological order
and returns one DataFrame per terminal stage; nothing runs until an action.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.parse import duration_ms
from flowspark.functions.redact import redact
from flowspark.operators.report import lookup
from flowspark.operators.queue import expire
from flowspark.operators.route import (RELATIONSHIP, fan_in, route, route_update, update,
                                       update_attributes)
from flowspark.operators.sinks import log_lines, store
from flowspark.sources.generate import generate_records
from flowspark.sources.requests import intake

SUCCESS = "success"


@dataclass(frozen=True)
class StageType:
    name: str
    fn: Callable[..., DataFrame]
    relationships: Callable[[dict], list[str]]
    source: bool = False


STAGE_TYPES: dict[str, StageType] = {}


def stage_type(name: str, relationships: Sequence[str] | Callable[[dict], list[str]] = (SUCCESS,),
               source: bool = False):
    """Register a stage type: ``@stage_type("my_stage") def f(df, **props) -> DataFrame``."""
    rels = relationships if callable(relationships) else (lambda props, r=list(relationships): r)

    def wrap(fn):
        STAGE_TYPES[name] = StageType(name, fn, rels, source)
        return fn
    return wrap


@dataclass
class Stage:
    name: str
    type: str
    props: dict
    auto_terminate: tuple[str, ...] = ()


@dataclass
class Edge:
    source: str
    destination: str
    relationships: tuple[str, ...]
    expiration: str = "0 sec"
    expiry_ts: str = "created_at"
    now: object = None


@dataclass
class Flow:
    name: str = "flow"
    stages: dict[str, Stage] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)

    @classmethod
    def from_spec(cls, spec: dict, frames: dict[str, DataFrame] | None = None) -> Flow:
        """Build a flow from a plain description::

            {"name": "route_and_store",
             "stages": [{"name": "route", "type": "route", "auto_terminate": ["unmatched"],
                         "properties": {"rules": {"large": {"expr": "size = 'large'"}}}}, ...],
             "connections": [{"source": "in", "destination": "route",
                              "relationships": ["success"]}, ...]}

        ``{"expr": "..."}`` values become Spark SQL expressions (``F.expr``);
        ``{"frame": "name"}`` values are taken from ``frames``.
        """
        frames = frames or {}

        def resolve(v):
            if isinstance(v, dict) and set(v) == {"expr"}:
                return F.expr(v["expr"])
            if isinstance(v, dict) and set(v) == {"frame"}:
                return frames[v["frame"]]
            if isinstance(v, dict):
                return {k: resolve(x) for k, x in v.items()}
            if isinstance(v, list):
                return [resolve(x) for x in v]
            return v

        flow = cls(spec.get("name", "flow"))
        for st in spec.get("stages", []):
            props = {k: resolve(v) for k, v in st.get("properties", {}).items()}
            flow.add(st["name"], st["type"], st.get("auto_terminate", ()), **props)
        for c in spec.get("connections", []):
            flow.connect(c["source"], c["destination"], c.get("relationships", (SUCCESS,)),
                         expiration=c.get("expiration", "0 sec"),
                         expiry_ts=c.get("expiry_ts", "created_at"), now=c.get("now"))
        return flow

    def add(self, name: str, type_: str, auto_terminate: Iterable[str] = (), **props) -> Flow:
        if name in self.stages:
            raise ValueError(f"stage exists: {name}")
        if type_ not in STAGE_TYPES:
            raise KeyError(f"unknown stage type: {type_}")
        self.stages[name] = Stage(name, type_, props, tuple(auto_terminate))
        return self

    def connect(self, source: str, destination: str,
                relationships: Iterable[str] = (SUCCESS,), expiration: str = "0 sec",
                expiry_ts: str = "created_at", now=None) -> Flow:
        """Connect ``source`` to ``destination`` for the selected relationships.

        ``expiration`` is the connection's record expiry ('0 sec' = never): rows
        older than it at ``now``, by ``expiry_ts``, are dropped on this edge.
        """
        if duration_ms(expiration) is None:
            raise ValueError(f"not a duration: {expiration!r}")
        for s in (source, destination):
            if s not in self.stages:
                raise KeyError(f"unknown stage: {s}")
        rels = tuple(relationships)
        known = self.relationships(source)
        bad = [r for r in rels if r not in known]
        if bad:
            raise ValueError(f"{source} has no relationship {bad}; it has {known}")
        self.edges.append(Edge(source, destination, rels, expiration, expiry_ts, now))
        return self

    def relationships(self, stage: str) -> list[str]:
        st = self.stages[stage]
        return STAGE_TYPES[st.type].relationships(st.props)

    def order(self) -> list[str]:
        indeg = {s: 0 for s in self.stages}
        for e in self.edges:
            indeg[e.destination] += 1
        ready = [s for s, d in indeg.items() if d == 0]
        out: list[str] = []
        while ready:
            s = ready.pop(0)
            out.append(s)
            for e in self.edges:
                if e.source == s:
                    indeg[e.destination] -= 1
                    if indeg[e.destination] == 0:
                        ready.append(e.destination)
        if len(out) != len(self.stages):
            raise ValueError("flow has a cycle")
        return out

    def validate(self) -> None:
        for name, st in self.stages.items():
            used = {r for e in self.edges if e.source == name for r in e.relationships}
            outgoing = any(e.source == name for e in self.edges)
            if not outgoing:
                continue  # a terminal stage: its output is the flow's result
            loose = [r for r in self.relationships(name) if r not in used and r not in st.auto_terminate]
            if loose:
                raise ValueError(f"{name}: relationships {loose} are neither connected nor auto-terminated")
            if STAGE_TYPES[st.type].source is False and not any(e.destination == name for e in self.edges):
                raise ValueError(f"{name} has no input")

    def describe(self, runner=None) -> list[dict]:
        """The flow's listing: one row per stage with its type, relationships,
        auto-terminated ones, inputs and, given a runner, its run state."""
        states = {r["name"]: r["state"] for r in runner.status()} if runner is not None else {}
        return [{"name": n, "type": st.type, "relationships": self.relationships(n),
                 "auto_terminate": list(st.auto_terminate),
                 "inputs": sorted({e.source for e in self.edges if e.destination == n}),
                 "state": states.get(n, "STOPPED" if runner is not None else None)}
                for n, st in self.stages.items()]

    def runner(self, spark: SparkSession, sinks: dict[str, dict] | None = None, **kw):
        """Start / stop / status handle for a flow whose sources are streams
        (see ``streaming.flow_runner``)."""
        from flowspark.streaming.runner import flow_runner
        return flow_runner(spark, self, sinks, **kw)

    def _single_pass(self) -> tuple[set[str], dict[str, tuple[str, dict, dict]]]:
        """Routes whose branches are update stages that meet again in one stage.

        Such a route, its updates and the fan-in are one pass (``route_update``)
        instead of a scan per branch. Returns the stages that it replaces, and
        per meeting stage the route's input, rules and updates.
        """
        fused: set[str] = set()
        merged: dict[str, tuple[str, dict, dict]] = {}
        plain = [e for e in self.edges if e.expiration == "0 sec"]
        for name, st in self.stages.items():
            into = [e for e in self.edges if e.destination == name]
            out = [e for e in self.edges if e.source == name]
            branches = [e.destination for e in out]
            if (st.type != "route" or len(into) != 1 or not out or len(set(branches)) != len(out)
                    or any(e not in plain or len(e.relationships) != 1 or e.relationships[0] not in st.props["rules"]
                           for e in out)):
                continue
            after = [e for e in self.edges if e.source in branches]
            ends = {e.destination for e in after}
            if (len(ends) != 1 or len(after) != len(out) or any(e not in plain for e in [*after, *into])
                    or any(self.stages[b].type != "update" or self.stages[b].auto_terminate
                           or sum(e.destination == b for e in self.edges) != 1 for b in branches)):
                continue
            end = ends.pop()
            upstream = self.stages[into[0].source]
            if (sum(e.destination == end for e in self.edges) != len(out) or into[0].relationships != (SUCCESS,)
                    or self.relationships(upstream.name) != [SUCCESS]):
                continue
            rules = {e.relationships[0]: st.props["rules"][e.relationships[0]] for e in out}
            updates = {e.relationships[0]: self.stages[e.destination].props["assignments"] for e in out}
            fused |= {name, *branches}
            merged[end] = into[0].source, rules, updates
        return fused, merged

    def run(self, spark: SparkSession, staging: str | None = None) -> dict[str, DataFrame]:
        """Run every terminal stage as a batch: store stages write and return
        their rejects (the failure relationship), others return their frame.
        ``staging``: see ``plan``."""
        out = {}
        for name, df in self.plan(spark, staging).items():
            st = self.stages[name]
            if st.type == "store":
                df = store(df, st.props["path"], st.props.get("by", "category"),
                           st.props.get("filename", "filename"),
                           order=st.props.get("order", ("created_at", "record_id")))
            out[name] = df
        return out

    def plan(self, spark: SparkSession, staging: str | None = None) -> dict[str, DataFrame]:
        """Lazy DataFrame per terminal stage (no outgoing edge).

        Branches that end in different stages read their common source once each.
        With a ``staging`` folder (shared, one per run) the rows of a stage with
        several successors are written there once, a folder per relationship, and
        every branch reads its own folders: the source is read a single time,
        whatever the number of sinks.
        """
        self.validate()
        outputs: dict[str, DataFrame] = {}
        fused, merged = self._single_pass()
        for name in self.order():
            st = self.stages[name]
            kind = STAGE_TYPES[st.type]
            props = dict(st.props)
            if "auto_terminate" in inspect.signature(kind.fn).parameters:
                props["auto_terminate"] = st.auto_terminate
            if name in fused:
                continue
            if name in merged:
                source, rules, updates = merged[name]
                df = kind.fn(route_update(outputs[source], rules, updates, keep_relationship=False), **props)
            elif kind.source:
                df = kind.fn(spark, **props)
            else:
                ins = []
                for e in self.edges:
                    if e.destination == name:
                        up = outputs[e.source]
                        if RELATIONSHIP in up.columns:
                            up = up.filter(F.col(RELATIONSHIP).isin(list(e.relationships))).drop(RELATIONSHIP)
                        ins.append(expire(up, e.expiration, ts=e.expiry_ts, now=e.now))
                if not ins:
                    raise ValueError(f"{name} has no input")
                df = kind.fn(fan_in(*ins), **props)
            if st.auto_terminate and RELATIONSHIP in df.columns:
                df = df.filter(~F.col(RELATIONSHIP).isin(list(st.auto_terminate)))
            after = {e.destination for e in self.edges if e.source == name} - fused
            if staging and len(after) > 1:
                df = _staged(df, f"{staging.rstrip('/')}/{name}")
            outputs[name] = df
        terminal = {n for n in self.stages if not any(e.source == n for e in self.edges)}
        return {n: outputs[n] for n in self.order() if n in terminal}


def _staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` (again, if a run is repeated) and read from there, a folder per relationship."""
    w = df.write.mode("overwrite")
    (w.partitionBy(RELATIONSHIP) if RELATIONSHIP in df.columns else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


# ---------------------------------------------------------------- built-in stage types
@stage_type("table", source=True)
def _table_stage(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """Any DataFrame (batch or streaming) as a source."""
    return frame


@stage_type("generate", source=True)
def _generate_stage(spark: SparkSession, firings: DataFrame, firing_id: str = "firing_id",
                    fired_at: str = "fired_at", batch_size: int = 1, file_size: str = "1KB",
                    custom_text: str | None = None) -> DataFrame:
    return generate_records(firings, firing_id, fired_at, batch_size, file_size, custom_text)


@stage_type("intake")
def _intake_stage(df: DataFrame, base_path: str = "/", header_regex: str = ".*", **kw) -> DataFrame:
    return intake(df, base_path, header_regex, **kw)


@stage_type("route", relationships=lambda p: [*p["rules"], "unmatched"])
def _route_stage(df: DataFrame, rules: dict, auto_terminate: tuple[str, ...] = ()) -> DataFrame:
    # Dropped unmatched rows let the raw rules act as a pushed-down pre-filter.
    return route(df, rules, keep_unmatched="unmatched" not in auto_terminate)


@stage_type("route_update", relationships=lambda p: list(p["rules"]))
def _route_update_stage(df: DataFrame, rules: dict, updates: dict) -> DataFrame:
    """Route plus per-branch updates in one pass (unmatched rows dropped)."""
    return route_update(df, rules, updates)


@stage_type("store", relationships=(SUCCESS, "failure"))
def _store_stage(df: DataFrame, path: str | None = None, by: str = "category", filename: str = "filename",
                 order: Sequence[str] = ("created_at", "record_id")) -> DataFrame:
    """Terminal: what ``Flow.run`` (or a runner, on a stream) stores with replace."""
    return df


@stage_type("update")
def _update_stage(df: DataFrame, assignments: dict) -> DataFrame:
    return update(df, assignments)


@stage_type("update_attributes")
def _update_attributes_stage(df: DataFrame, assignments: dict) -> DataFrame:
    return update_attributes(df, assignments)


@stage_type("filter", relationships=("matched", "unmatched"))
def _filter_stage(df: DataFrame, condition) -> DataFrame:
    return df.withColumn(RELATIONSHIP, F.when(F.coalesce(condition, F.lit(False)), "matched")
                         .otherwise("unmatched"))


@stage_type("log", relationships=(SUCCESS,))
def _log_stage(df: DataFrame, level: str = "info", payload: bool = False,
               min_level: str | None = None, columns: dict | None = None) -> DataFrame:
    return log_lines(df, level=level, payload=payload, min_level=min_level, columns=columns)


@stage_type("expire")
def _expire_stage(df: DataFrame, ttl: str = "0 sec", ts: str = "created_at", now=None) -> DataFrame:
    return expire(df, ttl, ts=ts, now=now)


@stage_type("redact")
def _redact_stage(df: DataFrame, column: str = "content") -> DataFrame:
    return df.withColumn(column, redact(column))


@stage_type("lookup")
def _lookup_stage(df: DataFrame, names: DataFrame, left_key: str, right_key: str,
                  columns: list[str]) -> DataFrame:
    return lookup(df, names, left_key, right_key, columns)
