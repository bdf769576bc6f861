"""Compute a value once within an expression, and maps that keep the first of repeated keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time.

    Written in place, the value would be computed again at each of its uses, and
    once per element inside a lambda; as the only element of an array it is bound to a variable.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def first_of_keys(keys: Column, values: Column) -> Column:
    """Map of two arrays in which the first of repeated keys counts; linear unless a key is repeated."""
    def build(pair: Column) -> Column:
        k, v = pair["k"], pair["v"]
        both = F.zip_with(k, v, lambda a, b: F.struct(a.alias("k"), b.alias("v")))
        entries = F.filter(both, lambda e, i: F.array_position(k, e["k"]) == i + 1)
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.map_from_arrays(k, v)).otherwise(
            F.map_from_entries(entries))

    return once(F.struct(keys.alias("k"), values.alias("v")), build)
