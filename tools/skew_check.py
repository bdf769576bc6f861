"""Measure how evenly skewed inputs spread over tasks (Spark event log).

Four cases derived from the events and orders tables:
  * queue_pressure with one queue holding 60% of rows (keyed window vs sliced);
  * threshold_alert with a third of all events in one 5-minute burst
    (bucketed vs prefix);
  * latest-wins with one (directory, filename) holding 60% of rows;
  * lookup (left join) with one key holding 1/3 of rows, as a sort-merge join.
For every shuffle stage it reports the largest task's share of the records the
stage read. Usage: python tools/skew_check.py [sf_dir] > report.json
The event log goes to a fresh folder under /tmp (a local tool, not a job).
"""

from __future__ import annotations

import collections
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def read_events(folder: str):
    import zstandard
    for f in sorted(glob.glob(f"{folder}/eventlog_v2_*/events_*")):
        with open(f, "rb") as fh:
            raw = fh.read()
        data = zstandard.ZstdDecompressor().stream_reader(raw).read() if f.endswith(".zstd") else raw
        for line in data.decode("utf-8").splitlines():
            yield json.loads(line)


def stage_shares(folder: str) -> dict:
    group, tasks = {}, collections.defaultdict(list)
    for e in read_events(folder):
        if e.get("Event") == "SparkListenerJobStart":
            g = (e.get("Properties") or {}).get("spark.jobGroup.id")
            for s in e.get("Stage IDs", []):
                group[s] = g
        elif e.get("Event") == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            tasks[e["Stage ID"]].append((m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0))
    out = collections.defaultdict(list)
    for s, t in sorted(tasks.items()):
        if sum(t) > 0 and len(t) > 1:
            out[group.get(s)].append({"stage": s, "tasks": len(t), "records": sum(t),
                                      "max_task_share": round(max(t) / sum(t), 3)})
    return dict(out)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="skew-eventlog-")
    spark = (SparkSession.builder.master("local[8]").appName("skew-check")
             .config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", log_dir).config("spark.sql.shuffle.partitions", "16")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from flowspark.operators import queue_pressure, threshold_alert

    ev = spark.read.parquet(f"{sf}/events.parquet")
    hot = ev.select("event_id", "ts", F.when(F.col("event_type").isin("view", "click", "purchase"), "hot")
                    .otherwise(F.col("event_type")).alias("queue"),
                    F.octet_length("props").cast("bigint").alias("size"))
    spark.sparkContext.setJobGroup("queue_pressure", "running totals")
    queue_pressure(hot, "queue", ["ts", "event_id"], "size").write.format("noop").mode("overwrite").save()
    burst_ts = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=(F.col("event_id") % 240).cast("decimal(18,6)"))
    burst = ev.select("event_id", F.when(F.col("event_id") % 3 == 0, burst_ts).otherwise(F.col("ts")).alias("ts"))
    spark.sparkContext.setJobGroup("threshold_alert", "running counts")
    rows = threshold_alert(burst, None, "ts", "5 minutes", 5).count()
    # latest-wins with one (directory, filename) holding 60% of rows, input in 16 map tasks
    from flowspark.operators import latest
    files = ev.repartition(16).select(
        F.col("event_type").alias("directory"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), F.lit("hot"))
        .otherwise(F.col("user_id").cast("string")).alias("filename"),
        "event_id", F.col("ts").alias("created_at"), "value")
    spark.sparkContext.setJobGroup("latest/hot_file", "latest")
    latest(files, ["directory", "filename"], ["created_at", "event_id"]) \
        .write.format("noop").mode("overwrite").save()
    # lookup (left join) with one customer holding 1/3 of orders, as a sort-merge
    # join; AQE's skew thresholds are lowered to this tiny data size
    from flowspark.operators import lookup
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1",
                 "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                 "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16384"}.items():
        spark.conf.set(k, v)
    # (spread over 16 map tasks, as a multi-file table would be: AQE splits a
    # skewed partition along map-task boundaries)
    orders = spark.read.parquet(f"{sf}/orders.parquet").repartition(16).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1)).otherwise(F.col("o_custkey"))
        .alias("o_custkey"))
    spark.sparkContext.setJobGroup("lookup/hot_customer", "lookup")
    lookup(orders, spark.read.parquet(f"{sf}/customer.parquet"), "o_custkey", "c_custkey", ["c_name"]) \
        .write.format("noop").mode("overwrite").save()
    spark.stop()
    print(json.dumps({"sf": sf, "alert_rows": rows, "stages": stage_shares(log_dir)}, indent=1))


if __name__ == "__main__":
    main()
