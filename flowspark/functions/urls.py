"""Request helpers: URL parts, query parameters and headers as attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowspark.functions.once import first_of_keys, once

# Fixed value: attribute-name prefix of query parameters.
QUERY_PARAM_PREFIX = "http.query.param."


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Split by position, not by a strict parser: any text has a path, whatever
# characters a client sent.
_PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?"


def url_path(url: str | Column) -> Column:
    return F.regexp_extract(_col(url), _PARTS, 1)


def url_query(url: str | Column) -> Column:
    """The query, '' if there is none (null only for a null URL)."""
    return F.regexp_extract(_col(url), _PARTS, 2)


def under_base_path(url: str | Column, base_path: str) -> Column:
    """Path equals ``/base`` or lies below it (``/base/...``); '/' takes all."""
    p = url_path(url)
    if not base_path.strip("/"):
        return p.isNotNull()
    base = "/" + base_path.strip("/")
    return F.coalesce((p == base) | F.startswith(p, F.lit(base + "/")), F.lit(False))


def query_params(url: str | Column, prefix: str = QUERY_PARAM_PREFIX) -> Column:
    """Query string → MAP<STRING,STRING>; key and value URL-decoded, keys prefixed.

    ``a=1&a=2&b=3&c&d=x=y`` → ``{a: 1, b: 3, c: '', d: 'x=y'}``: split on the
    first '=', a key without '=' gets '', and the first of repeated keys wins
    (``map_from_entries`` would raise on a duplicate).
    """
    q = F.coalesce(url_query(url), F.lit(""))
    parts = F.filter(F.split(q, "&"), lambda p: p != "")

    def key(p: Column) -> Column:
        name = F.substring_index(p, "=", 1)
        return F.concat(F.lit(prefix), F.coalesce(F.try_url_decode(name), name))

    def value(p: Column) -> Column:
        eq = F.instr(p, "=")
        text = F.when(eq > 0, F.substr(p, eq + 1)).otherwise(F.lit(""))
        return F.coalesce(F.try_url_decode(text), text)

    return once(parts, lambda ps: first_of_keys(F.transform(ps, key), F.transform(ps, value)))


def header_attributes(headers: str | Column, regex: str = ".*") -> Column:
    """Headers whose name fully matches ``regex`` become attributes."""
    pattern = f"^(?:{regex})$"
    return F.map_filter(_col(headers), lambda k, v: F.regexp_like(k, F.lit(pattern)))
