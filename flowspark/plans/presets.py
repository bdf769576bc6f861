"""Ready-made flows: route-and-store (the flagship) and the generate → log sample."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.text import append, format_time, now_column, template
from flowspark.operators.route import RELATIONSHIP, route, update


def route_and_update(df: DataFrame, rules: Mapping[str, Column], filename: Column,
                     now: str | Column | None = None, root: str = "output",
                     prefilter: bool = True) -> DataFrame:
    """Route, then the per-branch attribute update in one projection.

    Same result as one update stage per branch followed by a fan-in, without
    the second scan: ``category`` = branch, ``processing_time`` = now as text,
    ``filename`` + '.' + branch, ``directory`` = root/category. Unmatched rows
    are dropped by the route's pre-filter.
    """
    routed = route(df, rules, prefilter=prefilter)
    rel = F.col(RELATIONSHIP)
    clock = now_column(now)
    ntz = isinstance(df.select(clock).schema[0].dataType, T.TimestampNTZType)
    return update(routed, {
        "category": rel,
        "processing_time": format_time(clock, ntz=ntz),
        "filename": append(filename, F.concat(F.lit("."), rel)),
        "directory": template(root.rstrip("/") + "/", rel),
    }).drop(RELATIONSHIP)


def sample_flow(firings: DataFrame, firing_id: str = "firing_id", fired_at: str = "fired_at",
                batch_size: int = 1, file_size: str = "1KB", custom_text: str | None = None,
                level: str = "info", payload: bool = True):
    """generate → log, the sample two-stage flow."""
    from flowspark.plans.flow import Flow
    return (Flow("sample")
            .add("generate", "generate", firings=firings, firing_id=firing_id, fired_at=fired_at,
                 batch_size=batch_size, file_size=file_size, custom_text=custom_text)
            .add("log", "log", auto_terminate=["success"], level=level, payload=payload)
            .connect("generate", "log", ["success"]))


def route_and_store_flow(source: DataFrame, rules: Mapping[str, Column], filename: Column,
                         now: str | Column | None = None, root: str = "output",
                         store_path: str | None = None, order: tuple[str, ...] = ("created_at", "record_id")):
    """intake table → route → one update stage per branch → store, as a Flow graph.

    The store replaces by (category, filename) under ``store_path``."""
    from flowspark.plans.flow import Flow
    flow = (Flow("route_and_store")
            .add("source", "table", frame=source)
            .add("route", "route", auto_terminate=["unmatched"], rules=dict(rules)))
    flow.connect("source", "route")
    clock = now_column(now)
    ntz = isinstance(source.select(clock).schema[0].dataType, T.TimestampNTZType)
    for branch in rules:
        flow.add(f"update_{branch}", "update", assignments={
            "category": F.lit(branch),
            "processing_time": format_time(clock, ntz=ntz),
            "filename": append(filename, "." + branch),
            "directory": F.lit(root.rstrip("/") + "/" + branch)})
        flow.connect("route", f"update_{branch}", [branch])
    flow.add("store", "store", path=store_path, by="category", filename="filename", order=list(order))
    for branch in rules:
        flow.connect(f"update_{branch}", "store")
    return flow
