"""Record operators: DataFrame in, DataFrame out."""

from flowspark.operators.alerts import (epoch_micros, error_rate_spike, expiry_warning,
                                        older_than, period_counts, rate_spikes, threshold_alert)
from flowspark.operators.generations import GenerationStore
from flowspark.operators.log_index import files_with, index_log, search_log
from flowspark.operators.prefix import running_totals
from flowspark.operators.queue import expire, prioritize, queue_pressure
from flowspark.operators.report import (classify, contains, counters, listing_text, lookup,
                                        project_listing, scan_listing, status_positions,
                                        status_summary, tail, transition)
from flowspark.operators.route import (RELATIONSHIP, UNMATCHED, drop_rel, fan_in, fan_out,
                                       route, route_update, select_rel, unmatched, update,
                                       update_attributes)
from flowspark.operators.rule_table import condition_counts, route_by_table, rule_index, unmatched_by_table
from flowspark.operators.sinks import (LEVELS, LogLayout, compact_store, latest, level_rank, log_lines, parse_log,
                                       read_store, store, write_log)

__all__ = [
    "epoch_micros", "error_rate_spike", "expiry_warning", "older_than", "period_counts", "rate_spikes", "threshold_alert",
    "GenerationStore", "running_totals", "expire", "prioritize", "queue_pressure", "classify", "contains",
    "counters", "listing_text", "lookup", "project_listing", "scan_listing", "status_positions",
    "status_summary", "tail", "transition", "RELATIONSHIP", "UNMATCHED", "drop_rel", "fan_in",
    "fan_out", "route", "route_update", "select_rel", "unmatched", "update", "update_attributes",
    "files_with", "index_log", "search_log", "condition_counts", "route_by_table", "rule_index", "unmatched_by_table", "LEVELS", "LogLayout", "compact_store",
    "latest", "level_rank", "log_lines", "parse_log", "read_store", "store", "write_log",
]
