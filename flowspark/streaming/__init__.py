"""Structured Streaming forms of the flows."""

from flowspark.streaming.alerts import error_counts_stream, event_time, sliding_alert, sliding_counts
from flowspark.streaming.io import (run_to_end, start_batches, start_file_sink, store_stream, stream_path,
                                   stream_table, with_trigger)
from flowspark.streaming.queues import latest_depth, latest_snapshot, queue_depth_stream, start_snapshot_sink
from flowspark.streaming.trailing import beat, error_spike_stream, trailing_counts, with_heartbeats
from flowspark.streaming.runner import FlowRunner, flow_runner, shared_runner

__all__ = ["error_counts_stream", "event_time", "sliding_alert", "sliding_counts", "run_to_end", "start_batches", "start_file_sink", "store_stream", "stream_path", "stream_table",
           "with_trigger", "FlowRunner", "flow_runner", "shared_runner", "latest_depth", "latest_snapshot", "queue_depth_stream",
           "start_snapshot_sink",
           "beat", "error_spike_stream", "trailing_counts", "with_heartbeats"]
