"""Listings, lookups, run summaries, transitions and log views on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.text import short_type
from flowspark.operators.prefix import running_totals

# Fixed value: shape of one listed item.
ITEM_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("revision", T.StructType([T.StructField("version", T.LongType())])),
    T.StructField("component", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("state", T.StringType()),
    ])),
])


def scan_listing(df: DataFrame, body: str, field: str = "processors",
                 item_schema: T.StructType = ITEM_SCHEMA, keep: Sequence[str] = ()) -> DataFrame:
    """JSON body ``{field: [...]}`` → one row per item; a missing key or empty
    array gives no row."""
    schema = T.StructType([T.StructField(field, T.ArrayType(item_schema))])
    parsed = F.from_json(F.col(body), schema)
    return df.select(*keep, F.explode(parsed[field]).alias("item"))


def project_listing(df: DataFrame, item: str = "item", keep: Sequence[str] = ()) -> DataFrame:
    """id, name, type, short type, state, revision (the listing columns)."""
    i = F.col(item)
    return df.select(*keep, i["id"].alias("id"), i["component"]["name"].alias("name"),
                     i["component"]["type"].alias("type"),
                     short_type(i["component"]["type"]).alias("short_type"),
                     i["component"]["state"].alias("state"),
                     i["revision"]["version"].alias("version"))


def listing_text(id_: Column, name: Column, type_: Column, state: Column) -> Column:
    """The ID/Name/Type/State block of a listing."""
    return F.format_string("ID: %s\nName: %s\nType: %s\nState: %s", id_, name, type_, state)


def lookup(df: DataFrame, names: DataFrame, left_key: str, right_key: str,
           columns: Sequence[str]) -> DataFrame:
    """Bulk id → name lookup as one left equi-join (no scan per id).

    No broadcast hint: the planner broadcasts ``names`` only when its measured
    size is under the threshold, else both sides shuffle on the key, and AQE
    splits a skewed key.
    """
    right = names.select(F.col(right_key).alias("__lk"), *columns)
    return df.join(right, F.col(left_key) == F.col("__lk"), "left").drop("__lk")


def classify(state: Column, desired: str, failed: Column | None = None) -> Column:
    """Outcome of asking for ``desired``: already_<x> or the verb, or failed."""
    verb = {"RUNNING": "started", "STOPPED": "stopped"}[desired]
    already = {"RUNNING": "already_running", "STOPPED": "already_stopped"}[desired]
    out = F.when(state == desired, F.lit(already)).otherwise(F.lit(verb))
    if failed is not None:
        out = F.when(failed, F.lit("failed")).otherwise(out)
    return out


def transition(df: DataFrame, state: str, desired: str, failed: Column | None = None,
               name: str = "outcome") -> DataFrame:
    return df.withColumn(name, classify(F.col(state), desired, failed))


def status_summary(df: DataFrame, outcome: str, classes: Sequence[str]) -> DataFrame:
    """One row, one count per class (zero included): a single global aggregate."""
    return df.agg(*[F.count_if(F.col(outcome) == c).alias(f"n_{c}") for c in classes],
                  F.count(F.lit(1)).alias("n_total"))


def status_positions(df: DataFrame, outcome: str, id_col: str) -> DataFrame:
    """Id lists per class in long form: (class, position, id), sorted by id.

    A class may hold most ids, so no list is collected into one cell or task.
    """
    base = df.select(F.col(outcome), F.col(id_col))
    return running_totals(base, [outcome], [id_col], {"position": F.lit(1).cast("bigint")})


def tail(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """Last ``n`` rows by ``order`` (descending): a top-k, no full sort."""
    return df.orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in order]).limit(n)


def contains(df: DataFrame, col: str, text: str) -> DataFrame:
    return df.filter(F.col(col).contains(text))


def counters(df: DataFrame, observation, size: str | None = "size") -> DataFrame:
    """Flow counters without an extra job: records and bytes seen, read from the
    ``Observation`` after an action (batch) or ``lastProgress.observedMetrics``
    (stream, where ``observation`` is a name)."""
    metrics = [F.count(F.lit(1)).alias("records")]
    if size:
        metrics.append(F.coalesce(F.sum(F.col(size)), F.lit(0)).cast("bigint").alias("bytes"))
    return df.observe(observation, *metrics)
