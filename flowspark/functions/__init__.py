"""Scalar functions of the attribute language, all native Column expressions."""

from flowspark.functions.checks import UUID_PATTERN, is_https, is_missing, is_uuid
from flowspark.functions.parse import (data_size_bytes, duration_ms, parse_data_size,
                                       parse_duration, trigger_interval)
from flowspark.functions.redact import drop_secret_keys, redact
from flowspark.functions.text import (TIME_FORMAT, append, default_if_empty, default_if_null,
                                      equals, format_time, now_column, preview, short_type,
                                      template, trim_trailing_slash)
from flowspark.functions.urls import (QUERY_PARAM_PREFIX, header_attributes, query_params,
                                      under_base_path, url_path, url_query)

__all__ = [
    "UUID_PATTERN", "is_https", "is_missing", "is_uuid", "data_size_bytes", "duration_ms",
    "parse_data_size", "parse_duration", "trigger_interval", "drop_secret_keys", "redact",
    "TIME_FORMAT", "append", "default_if_empty", "default_if_null", "equals", "format_time",
    "now_column", "preview", "short_type", "template", "trim_trailing_slash",
    "QUERY_PARAM_PREFIX", "header_attributes", "query_params", "under_base_path", "url_path",
    "url_query",
]
