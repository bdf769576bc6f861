"""Redaction of secrets and personal data before logging."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns (Java regex) and their replacements, applied in this order.
REDACTIONS = [
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+", "$1***"),
    (r"(?i)(password|passwd|pwd|secret|token|api[_-]?key)(\s*[:=]\s*)[^\s,;]+", "$1$2***"),
    # An address: entered at the start of a run of its characters (or where the
    # last match ended), and without a repeated group of unknown width, so long
    # runs cost linear time and no stack.
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-])(?:(?!\.\.)[A-Za-z0-9.-])+\.[A-Za-z]{2,}",
     "[email]"),
]

# Fixed value: attribute names never logged.
SECRET_KEYS = ["password", "token", "secret", "authorization", "api_key"]


def redact(c: str | Column) -> Column:
    """Apply ``REDACTIONS`` in order. Each pattern runs only where a cheap
    necessary condition holds (its keyword or '@' occurs), which skips the
    regex scan on most texts without changing any result."""
    text = F.col(c) if isinstance(c, str) else c
    low = F.lower(text)
    guards = [low.contains("bearer"),
              low.rlike("password|passwd|pwd|secret|token|api[_-]?key"),
              text.contains("@")]
    out = text
    for (pattern, repl), guard in zip(REDACTIONS, guards):
        out = F.when(guard, F.regexp_replace(out, pattern, repl)).otherwise(out)
    return out


def drop_secret_keys(attributes: str | Column, keys: Iterable[str] = SECRET_KEYS) -> Column:
    m = F.col(attributes) if isinstance(attributes, str) else attributes
    banned = F.array(*[F.lit(k) for k in keys])
    return F.map_filter(m, lambda k, v: ~F.array_contains(banned, F.lower(k)))
