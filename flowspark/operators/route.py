"""Routing, relationship selection, attribute updates, fan-out and fan-in.

All narrow: a route is one Filter + Generate, an update one Project, a fan-in
one Union. No shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.records import ATTRIBUTES, attribute_map

RELATIONSHIP = "relationship"
UNMATCHED = "unmatched"


def _any(rules: Mapping[str, Column]) -> Column:
    return reduce(lambda a, b: a | b, rules.values())


def route(df: DataFrame, rules: Mapping[str, Column], keep_unmatched: bool = False,
          prefilter: bool = True, name: str = RELATIONSHIP) -> DataFrame:
    """Route to property name: add ``relationship``, one row per true rule.

    Rule order has no meaning. A null rule (missing attribute) is not a match.
    Without ``keep_unmatched`` the raw OR of the rules is the pre-filter, so a
    plain comparison on a real column reaches the Parquet scan; pass
    ``prefilter=False`` when the rules use a column that is costly to build (an
    attribute map), which a filter would build once more.
    """
    if not rules:
        raise ValueError("route needs at least one rule")
    if UNMATCHED in rules:
        raise ValueError(f"'{UNMATCHED}' is reserved")
    src = df.filter(_any(rules)) if prefilter and not keep_unmatched else df
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    if keep_unmatched:
        hits = F.when(F.size(hits) == 0, F.array(F.lit(UNMATCHED))).otherwise(hits)
    return src.withColumn(name, F.explode(hits))


def unmatched(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows no rule matches (null counts as not matched)."""
    return df.filter(~F.coalesce(_any(rules), F.lit(False))).withColumn(RELATIONSHIP, F.lit(UNMATCHED))


def select_rel(df: DataFrame, *names: str, name: str = RELATIONSHIP) -> DataFrame:
    """A connection's selected relationships."""
    return df.filter(F.col(name).isin(list(names)))


def drop_rel(df: DataFrame, *names: str, name: str = RELATIONSHIP) -> DataFrame:
    """Auto-terminated relationships: their rows are discarded."""
    if not names:
        return df
    return df.filter(~F.col(name).isin(list(names)))


def update(df: DataFrame, assignments: Mapping[str, Column | str]) -> DataFrame:
    """Add or overwrite several columns at once; every right side sees the input row."""
    return df.withColumns({k: (F.lit(v) if isinstance(v, str) else v) for k, v in assignments.items()})


def update_attributes(df: DataFrame, assignments: Mapping[str, Column | str],
                      attributes: str = ATTRIBUTES) -> DataFrame:
    """The same on the attribute map: overwritten keys replaced, new keys added.

    Right sides see the old map. A null right side removes the key.
    """
    if not assignments:
        return df
    keys = list(assignments)
    new = attribute_map({k: (F.lit(v) if isinstance(v, str) else v) for k, v in assignments.items()})
    banned = F.array(*[F.lit(k) for k in keys])
    kept = F.map_filter(F.col(attributes), lambda k, v: ~F.array_contains(banned, k))
    return df.withColumn(attributes, F.map_concat(kept, new))


def route_update(df: DataFrame, rules: Mapping[str, Column],
                 updates: Mapping[str, Mapping[str, Column | str]],
                 keep_relationship: bool = True) -> DataFrame:
    """Route, then each branch's own assignments, in one pass.

    ``updates`` maps a branch to its ``{column: value}``. Every assigned column
    becomes one CASE on ``relationship``; a branch that does not assign a
    column keeps its old value (null when the column is new). The result
    equals one update stage per branch followed by a fan-in, without scanning
    the source once per branch. Unmatched rows are dropped.
    """
    unknown = set(updates) - set(rules)
    if unknown:
        raise ValueError(f"updates for unknown branches: {sorted(unknown)}")
    routed = route(df, rules)
    rel = F.col(RELATIONSHIP)
    columns: dict[str, Column] = {}
    for col in dict.fromkeys(c for assigns in updates.values() for c in assigns):
        expr = F.col(col) if col in df.columns else F.lit(None)
        for branch, assigns in updates.items():
            if col in assigns:
                v = assigns[col]
                expr = F.when(rel == branch, F.lit(v) if isinstance(v, str) else v).otherwise(expr)
        columns[col] = expr
    out = routed.withColumns(columns)
    return out if keep_relationship else out.drop(RELATIONSHIP)


def fan_out(df: DataFrame, branches: Mapping[str, Column]) -> dict[str, DataFrame]:
    """One filtered DataFrame per branch (each one re-reads the source when acted on;
    prefer ``route`` + ``update`` keyed on ``relationship`` for a single pass)."""
    return {n: df.filter(c) for n, c in branches.items()}


def fan_in(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name; a column missing on one side is null there."""
    if not dfs:
        raise ValueError("fan_in needs at least one input")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
