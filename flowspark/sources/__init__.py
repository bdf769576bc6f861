"""Sources: generator, captured requests, log text, tables."""

from flowspark.sources.generate import (filler, generate_records, generate_stream, schedule,
                                        schedule_stream)
from flowspark.sources.logs import read_log, read_log_blocks
from flowspark.sources.requests import REQUEST_SCHEMA, intake, intake_once, read_requests, rejected_requests
from flowspark.sources.tables import TABLES, table

__all__ = ["filler", "generate_records", "generate_stream", "schedule", "schedule_stream",
           "read_log", "REQUEST_SCHEMA", "intake", "intake_once", "read_requests", "rejected_requests", "read_log_blocks", "TABLES", "table"]
