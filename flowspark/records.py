"""The flow record: fixed envelope plus an open string map of attributes.

``record_id STRING, created_at TIMESTAMP, attributes MAP<STRING,STRING>,
content STRING, size BIGINT``. Operators take plain Columns, so a caller with
typed columns skips the map entirely (the fast path: predicates on real
columns reach the Parquet scan; map lookups do not).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD_ID = "record_id"
CREATED_AT = "created_at"
ATTRIBUTES = "attributes"
CONTENT = "content"
SIZE = "size"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_size(content: str | Column) -> Column:
    """Record size in bytes (UTF-8 octets, not characters)."""
    return F.octet_length(_col(content)).cast("bigint")


def attribute_map(attributes: Mapping[str, str | Column]) -> Column:
    """MAP<STRING,STRING> from named columns; null values stay out of the map."""
    empty = F.create_map().cast("map<string,string>")
    if not attributes:
        return empty
    # One single-entry map per present value, concatenated: no lambda, so the
    # whole projection stays in generated code.
    parts = []
    for k, v in attributes.items():
        val = _col(v).cast("string")
        parts.append(F.when(val.isNotNull(), F.create_map(F.lit(k), val)).otherwise(empty))
    return F.map_concat(*parts) if len(parts) > 1 else parts[0]


def to_records(df: DataFrame, record_id: str | Column, created_at: str | Column,
               content: str | Column | None = None,
               attributes: Mapping[str, str | Column] | None = None,
               keep: list[str] | None = None) -> DataFrame:
    """Wrap any table into the record envelope (one narrow projection)."""
    body = _col(content).cast("string") if content is not None else F.lit(None).cast("string")
    cols = [
        _col(record_id).cast("string").alias(RECORD_ID),
        _col(created_at).alias(CREATED_AT),
        attribute_map(attributes or {}).alias(ATTRIBUTES),
        body.alias(CONTENT),
        content_size(body).alias(SIZE),
    ]
    return df.select(*cols, *(keep or []))


def attr(name: str, columns: Mapping[str, str] | None = None,
         attributes: str = ATTRIBUTES) -> Column:
    """Attribute read (``${name}``): a mapped real column, else the map entry.

    A missing key gives null, so an equality rule on it is not matched.
    """
    if columns and name in columns:
        return F.col(columns[name])
    return F.col(attributes).getItem(name)
