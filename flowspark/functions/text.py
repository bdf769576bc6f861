"""Scalar text helpers of the attribute language, as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the timestamp text layout used by the attribute updates.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def append(c: str | Column, suffix: str | Column) -> Column:
    """``${a:append('s')}``: a missing attribute counts as empty text."""
    s = F.lit(suffix) if isinstance(suffix, str) else suffix
    return F.concat(F.coalesce(_col(c), F.lit("")), F.coalesce(s, F.lit("")))


def equals(c: str | Column, value: str) -> Column:
    """``${a:equals('v')}``: null (missing) stays null, so it never matches."""
    return _col(c) == F.lit(value)


def format_time(ts: str | Column, pattern: str = TIME_FORMAT, ntz: bool = False) -> Column:
    """Time → text. For a TIMESTAMP_NTZ value (``ntz=True``) in the default
    layout, the wall clock is printed as is, without the session time zone
    (``date_format`` converts through it, which cannot print a wall-clock time
    inside a daylight-saving gap)."""
    if ntz and pattern == TIME_FORMAT:
        return F.substr(_col(ts).cast("string"), F.lit(1), F.lit(19))
    return F.date_format(_col(ts), pattern)


def now_column(now: str | Column | None = None) -> Column:
    """Injectable clock: a Column, a literal 'yyyy-MM-dd HH:mm:ss' (NTZ), or now."""
    if now is None:
        return F.localtimestamp()
    if isinstance(now, str):
        return F.lit(now).cast("timestamp_ntz")
    return now


def template(*parts: str | Column) -> Column:
    """``"/out/${category}"``: strings are literal, Columns are values; null → ''."""
    if not parts:
        return F.lit("")
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit(""))
                      for p in parts])


def short_type(c: str | Column) -> Column:
    """Last part of a dotted type name."""
    return F.element_at(F.split(_col(c), "[.]"), -1)


def preview(c: str | Column, n: int = 50) -> Column:
    """First ``n`` characters."""
    return F.left(_col(c), F.lit(n))


def trim_trailing_slash(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), "/+$", "")


def default_if_empty(c: str | Column, default: str | Column) -> Column:
    """Shell ``${VAR:-d}``: null or empty text takes the default."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(_col(c), F.lit("")), d)


def default_if_null(c: str | Column, default: str | Column) -> Column:
    """``getenv(k, d)``: only a missing value takes the default; '' is kept."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(_col(c), d)
