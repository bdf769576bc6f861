"""Row-level checks used as filters or quality flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: canonical 8-4-4-4-12 hexadecimal UUID form.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: str | Column) -> Column:
    """Null, empty or the text 'null' (what a JSON tool prints for a missing id)."""
    x = _col(c)
    return x.isNull() | (x == "") | (x == "null")


def is_https(c: str | Column) -> Column:
    return F.coalesce(F.startswith(_col(c), F.lit("https://")), F.lit(False))


def is_uuid(c: str | Column) -> Column:
    return F.coalesce(F.regexp_like(_col(c), F.lit(UUID_PATTERN)), F.lit(False))
