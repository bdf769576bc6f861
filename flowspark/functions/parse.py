"""Parsers for data-size and duration texts ('1KB', '1 GB', '60 sec').

Each has a Column form for tables and a Python twin for driver-side options
(trigger intervals, read caps). Units are 1024-based; an unknown unit → null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names and their factors.
SIZE_UNITS = {"b": 1, "byte": 1, "bytes": 1, "kb": 1024, "mb": 1024 ** 2,
              "gb": 1024 ** 3, "tb": 1024 ** 4}
DURATION_UNITS = {"ms": 1, "milli": 1, "millis": 1, "millisecond": 1, "milliseconds": 1,
                  "s": 1000, "sec": 1000, "secs": 1000, "second": 1000, "seconds": 1000,
                  "m": 60_000, "min": 60_000, "mins": 60_000, "minute": 60_000, "minutes": 60_000,
                  "h": 3_600_000, "hr": 3_600_000, "hrs": 3_600_000, "hour": 3_600_000,
                  "hours": 3_600_000, "d": 86_400_000, "day": 86_400_000, "days": 86_400_000}

_PATTERN = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]*)\s*$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _scaled(c: str | Column, units: dict[str, int]) -> Column:
    text = _col(c)
    number = F.regexp_extract(text, _PATTERN, 1)
    unit = F.lower(F.regexp_extract(text, _PATTERN, 2))
    factor = F.lit(None).cast("bigint")
    for name, mult in reversed(list(units.items())):
        factor = F.when(unit == name, F.lit(mult)).otherwise(factor)
    # try_* throughout: untrusted text never raises, an overflow is null
    scaled = F.try_multiply(number.try_cast("decimal(38,9)"), factor)
    value = F.when(number != "", F.floor(scaled))
    return value.try_cast("bigint")


def parse_data_size(c: str | Column) -> Column:
    """'1KB' → 1024, '1 GB' → 1073741824, '5 furlong' → null. No unit = bytes."""
    return _scaled(F.when(F.regexp_like(_col(c), F.lit(r"^\s*[0-9.]+\s*$")),
                          F.concat(_col(c), F.lit("B"))).otherwise(_col(c)), SIZE_UNITS)


def parse_duration(c: str | Column) -> Column:
    """'60 sec' → 60000 ms, '0 sec' → 0, unknown unit → null."""
    return _scaled(c, DURATION_UNITS)


def _py_scaled(text: str, units: dict[str, int], bare_unit: str | None) -> int | None:
    m = re.match(_PATTERN, text or "")
    if not m:
        return None
    unit = (m.group(2) or bare_unit or "").lower()
    if unit not in units:
        return None
    from decimal import Decimal
    value = int(Decimal(m.group(1)) * units[unit])
    return value if value < 2 ** 63 else None  # beyond BIGINT: null, as the Column form


def data_size_bytes(text: str) -> int | None:
    return _py_scaled(text, SIZE_UNITS, "b")


def duration_ms(text: str) -> int | None:
    return _py_scaled(text, DURATION_UNITS, None)


def trigger_interval(text: str) -> str:
    """'60 sec' → '60000 milliseconds', the form ``trigger(processingTime=…)`` takes."""
    ms = duration_ms(text)
    if ms is None:
        raise ValueError(f"not a duration: {text!r}")
    return f"{ms} milliseconds"
