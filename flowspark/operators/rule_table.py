"""Routing by a table of rules instead of one expression per rule.

A rule is a conjunction of ``attribute = value`` conditions, kept as one row a
condition: (rule, attribute, value). With thousands of rules a CASE per rule no
longer fits a plan; here the rules become an index that is joined.

Each rule is filed under one of its conditions, the rarest one. A record looks
up its own attributes in that index, one equi-join, and the rules it finds
count their other conditions on the record itself. No record is grouped or
compared with a rule that shares nothing with it, so the work follows the number of
rarest-condition hits and not records times rules.

Defined results: a rule with a null attribute or value, or with two values for
one attribute, never matches; rows with a null rule name are no rules; repeated
rows count once. A null map or a null value in it has no attribute. Repeated
records are routed each by itself. A rule's conditions are one cell, as a record's
attributes are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.route import RELATIONSHIP, UNMATCHED
from flowspark.records import ATTRIBUTES


def condition_counts(df: DataFrame, rules: DataFrame, attributes: str = ATTRIBUTES) -> DataFrame:
    """(attribute, value, n): how many records meet each condition that some rule asks for."""
    asked = rules.select("attribute", "value").distinct()
    had = df.select(F.explode(F.col(attributes)).alias("attribute", "value"))
    # Counted before the join, so a value that a third of the records hold is one row of it.
    return had.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n")).join(asked, ["attribute", "value"])


def rule_index(rules: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(attribute, value, rule, conditions): each rule once, under its rarest condition.

    ``counts`` (attribute, value, n) says how often a condition holds, as
    ``condition_counts`` finds it in a batch or in yesterday's records. Without
    it the condition that the fewest rules share is taken. It only steers the
    work; the matches are the same. Write the result to a table before routing: read
    back, its size is known and a skewed join can be split.
    """
    rows = rules.filter(F.col("rule").isNotNull()).select("rule", "attribute", "value").distinct()
    if counts is None:
        counts = rows.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    valid = (rows.groupBy("rule")
             .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("attribute").alias("n_attributes"),
                  F.count_if(F.col("attribute").isNull() | F.col("value").isNull()).alias("n_null"))
             .filter((F.col("n_rows") == F.col("n_attributes")) & (F.col("n_null") == 0)).select("rule"))
    condition = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "attribute", "value")
    filed = (rows.join(valid, "rule", "left_semi").join(counts.select("attribute", "value", "n"), ["attribute", "value"], "left")
             .groupBy("rule").agg(F.min(condition).alias("rarest"), F.collect_list(F.struct("attribute", "value")).alias("conditions")))
    return filed.select("rarest.attribute", "rarest.value", "rule", "conditions")


def route_by_table(df: DataFrame, index: DataFrame, attributes: str = ATTRIBUTES, name: str = RELATIONSHIP) -> DataFrame:
    """Every record once per rule of ``index`` that it meets, with the rule's name in ``name``.

    Works on a batch and on a stream (the index is then a static table). Columns
    of ``df`` may have any name; a column called ``name`` is replaced.
    """
    keep = [c for c in df.columns if c != name]
    # The record travels packed, so that no column of it meets one of the index.
    sent = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"),
                     F.explode(F.col(f"`{attributes}`")).alias("attribute", "value"))
    held = F.col("record")[attributes]
    met = F.filter("conditions", lambda c: F.coalesce(held[c["attribute"]] == c["value"], F.lit(False)))
    found = sent.join(index, ["attribute", "value"]).filter(F.size(met) == F.size("conditions"))
    return found.select(*[F.col("record")[c].alias(c) for c in keep], F.col("rule").alias(name))


def unmatched_by_table(df: DataFrame, routed: DataFrame, key: Sequence[str], name: str = RELATIONSHIP) -> DataFrame:
    """Records of ``df`` that no rule took, as ``unmatched``; rows with equal ``key`` (nulls are equal) share a fate."""
    seen = routed.select(*[F.col(f"`{c}`").alias(f"__seen_{k}") for k, c in enumerate(key)]).distinct()
    same = reduce(lambda a, b: a & b, [df[f"`{c}`"].eqNullSafe(seen[f"__seen_{k}"]) for k, c in enumerate(key)])
    return df.join(seen, same, "left_anti").withColumn(name, F.lit(UNMATCHED))
