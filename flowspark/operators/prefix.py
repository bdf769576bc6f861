"""Running totals per key that stay parallel when one key holds most rows.

``Window.partitionBy(key)`` sends every row of a key to one task. Here the
rows of all keys are cut in (key, order) order into slices of about equal size,
so a hot key, or many rows at one point of the order, spread over many slices.

The slice bounds come from a sample whose size depends on the number of slices
alone, and go into the plan as literals. A row's slice therefore depends on the
row and nothing else: the slice totals are aggregated from the input before
anything is shuffled, the total of a key's earlier slices enters each slice as
one more row ahead of its own, and a single shuffle by slice with one window
per (slice, key) gives the running totals. Nothing is written, and a lost
executor's rows fall into the same slices again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.once import once

PER_SLICE = 24   # sampled rows a slice: its size is then within about half of the mean, mostly


def sortable(df: DataFrame, name: str) -> tuple[Column, str]:
    """A column in the order of ``name`` whose values can be literals (times as microseconds), and its type."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)"), "bigint"
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c), "bigint"
    if isinstance(kind, T.DateType):
        return F.unix_date(c), "int"
    if isinstance(kind, T.BooleanType):
        return c.cast("int"), "int"
    if isinstance(kind, (T.NumericType, T.StringType)):
        return c, kind.simpleString()
    raise ValueError(f"{name}: {kind.simpleString()} can't order slices; use a number, a text or a time")


def slice_bounds(at: DataFrame, n: int) -> list[tuple]:
    """At most ``n`` - 1 values of the struct column ``at`` that cut the rows into slices of about equal size."""
    rows = at.count()
    if rows == 0 or n < 2:
        return []
    sample = at.sample(min(1.0, PER_SLICE * n / rows), 17) if rows > PER_SLICE * n else at
    seen = sample.agg(F.sort_array(F.collect_list("at"))).first()[0]  # about PER_SLICE * n values
    cuts = [tuple(seen[k * len(seen) // n]) for k in range(1, n)] if seen else []
    return list(dict.fromkeys(cuts))


def slice_of(at: Column, kinds: Sequence[str], bounds: Sequence[tuple]) -> Column:
    """How many bounds are at or before ``at``."""
    def text(value: object, kind: str) -> str:
        if isinstance(value, str):
            return f"decode(X'{value.encode().hex()}', 'UTF-8')"
        return f"CAST(NULL AS {kind})" if value is None else f"CAST('{value}' AS {kind})"

    def array(cuts: Sequence[tuple]) -> str:
        return "array({})".format(", ".join("named_struct({})".format(", ".join(
            f"'c{i}', {text(v, k)}" for i, (v, k) in enumerate(zip(cut, kinds)))) for cut in cuts))

    cuts, n = F.expr(array(bounds)), len(bounds)

    def search(x: Column, found: Column, step: int) -> Column:
        """Binary search: bounds 1 to ``found`` are at or before x, none beyond ``found + 2 * step - 1``."""
        if not step:
            return found
        beyond = F.try_element_at(cuts, found + step) <= x  # null past the last bound
        return once(F.when(beyond, found + step).otherwise(found), lambda k: search(x, k, step // 2))

    if not bounds:
        return F.lit(0)
    return once(at, lambda x: search(x, F.lit(0), 1 << (n.bit_length() - 1)))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   sums: Mapping[str, Column | str], slices: int | None = None) -> DataFrame:
    """Add ``name = SUM(expr) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED PRECEDING)``.

    ``order`` must make rows unique within a key (add the id), as with ROWS
    frames; keys and order are numbers, texts, times or booleans, null first.
    Values may be of any sign; null counts as 0. Lazy but for the bounds (a
    count and a sample); the input is read again by the plan and must hold the same rows then.
    """
    p = "__"
    while any(c.startswith(p) for c in [*df.columns, *sums]):
        p += "_"
    n = slices or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = [sortable(df, c) for c in [*keys, *order]]
    at = F.struct(*[c.alias(f"c{i}") for i, (c, _) in enumerate(places)])
    bounds = slice_bounds(df.select(at.alias("at")), n)
    vals = {f"{p}v{i}": F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for i, c in enumerate(sums.values())}
    rows = df.withColumns({**vals, f"{p}slice": slice_of(at, [k for _, k in places], bounds), f"{p}own": F.lit(True)})

    totals = rows.groupBy(f"{p}slice", *keys).agg(*[F.sum(v).alias(v) for v in vals])
    earlier = Window.partitionBy(*keys).orderBy(f"{p}slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(f"{p}slice", *keys, F.lit(False).alias(f"{p}own"),
                            *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in vals])
    rest = [f for f in df.schema.fields if f.name not in keys]
    carried = carried.withColumns({f.name: F.lit(None).cast(f.dataType) for f in rest})
    both = rows.unionByName(carried).repartition(f"{p}slice")
    upto = (Window.partitionBy(f"{p}slice", *keys).orderBy(f"{p}own", *order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = both.withColumns({name: F.sum(v).over(upto) for v, name in zip(vals, sums)})
    return out.filter(f"{p}own").select(*df.columns, *sums)
