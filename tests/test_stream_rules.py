"""Alerts on a stream that count what their rules say, and flows whose sinks share one read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import error_rate_spike
from flowspark.plans.flow import Flow
from flowspark.session import work_dir
from flowspark.streaming import (beat, error_spike_stream, latest_snapshot, run_to_end, shared_runner, start_file_sink,
                                 start_snapshot_sink, stream_path, trailing_counts)
from flowspark.streaming.shared import start_shared, store_of

T0 = dt.datetime(2024, 1, 1)
EVENTS = "id long, k string, ts timestamp_ntz"


def land(spark, path, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def exact(rows, seconds):
    return {i: sum(1 for _, k2, u in rows if k2 == k and t - dt.timedelta(seconds=seconds) <= u <= t) for i, k, t in rows}


def test_trailing_counts_follow_late_events_restarts_and_the_watermark(spark):
    base = work_dir(spark, "trailing")
    rnd = random.Random(3)
    times = sorted(rnd.randrange(3000) for _ in range(300))
    rows = [(i, rnd.choice(["hot", "hot", "a", None]), T0 + dt.timedelta(seconds=s)) for i, s in enumerate(times)]
    for k in range(0, 300, 100):  # some come a file later: late, but within the delay
        part = rows[k:k + 90] + rows[k + 95:k + 100] + (rows[k - 10:k - 5] if k else [])
        land(spark, f"{base}/in", part)
        df = trailing_counts(stream_path(spark, f"{base}/in", max_files_per_trigger=1), "k", "ts", "id", "100 sec", "400 sec")
        run_to_end(start_snapshot_sink(df, f"{base}/out", f"{base}/cp", available_now=True))  # restarts each time
    got = {r.id: r.n_recent for r in latest_snapshot(spark, f"{base}/out", "id").collect()}
    assert got == exact(rows[:290] + rows[295:], 100)
    told = spark.read.parquet(f"{base}/out").groupBy("id").count().filter("count > 1").count()
    assert told > 0  # counts that a late event changed went out again
    land(spark, f"{base}/in", [(999, "hot", T0)])  # far behind the watermark: dropped
    df = trailing_counts(stream_path(spark, f"{base}/in"), "k", "ts", "id", "100 sec", "400 sec")
    run_to_end(start_snapshot_sink(df, f"{base}/out", f"{base}/cp", available_now=True))
    assert {r.id: r.n_recent for r in latest_snapshot(spark, f"{base}/out", "id").collect()} == got


def test_trailing_counts_hold_the_period_only(spark):
    base = work_dir(spark, "trailing_state")
    for k in range(4):
        land(spark, f"{base}/in", [(100 * k + i, "a", T0 + dt.timedelta(hours=k, seconds=i)) for i in range(100)])
    df = trailing_counts(stream_path(spark, f"{base}/in", max_files_per_trigger=1), "k", "ts", "id", "10 sec", "5 sec")
    q = run_to_end(start_snapshot_sink(df, f"{base}/out", f"{base}/cp", available_now=True))
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) <= 1
    got = {r.id: r.n_recent for r in latest_snapshot(spark, f"{base}/out", "id").collect()}
    assert got == {100 * k + i: min(i, 10) + 1 for k in range(4) for i in range(100)}


def test_trailing_counts_deal_a_hot_key_by_time(spark):
    base = work_dir(spark, "trailing_spans")
    rnd = random.Random(7)
    rows = [(i, "hot", T0 + dt.timedelta(seconds=rnd.randrange(-900, 900) + 86400 * rnd.randrange(1, 5)))
            for i in range(400)]  # around midnights, in no order
    for k in (0, 200):
        land(spark, f"{base}/in", rows[k:k + 200])
    df = trailing_counts(stream_path(spark, f"{base}/in", max_files_per_trigger=1), "k", "ts", "id", "600 sec", "10 days")
    q = run_to_end(start_snapshot_sink(df, f"{base}/out", f"{base}/cp", available_now=True))
    got = {r.id: r.n_recent for r in latest_snapshot(spark, f"{base}/out", "id").collect()}
    assert got == exact(rows, 600)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(states) > 3  # the one key is several groups


def test_spikes_in_one_streaming_query_equal_the_batch(spark):
    base = work_dir(spark, "spikes")
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["error", "ok", "ok", None]), T0 + dt.timedelta(minutes=rnd.choice([i, i, i + 9]) * 3))
            for i in range(600) if not 200 < i < 320]  # some hours have no event
    rows.sort(key=lambda r: r[2])
    beat(spark, f"{base}/beats")
    for k in range(0, len(rows), 160):
        land(spark, f"{base}/in", rows[k:k + 160])
    df = stream_path(spark, f"{base}/in", max_files_per_trigger=1)
    spikes = error_spike_stream(df, "ts", F.col("k") == "error", "1 hour", 3, 0.05, "40 minutes", f"{base}/beats")
    run = lambda: run_to_end(start_file_sink(spikes, f"{base}/out", f"{base}/cp", available_now=True))
    run()
    read = lambda: sorted(map(tuple, spark.read.schema(spikes.schema).parquet(f"{base}/out").collect()))
    want = sorted(map(tuple, error_rate_spike(spark.createDataFrame(rows, EVENTS), "ts", F.col("k") == "error").collect()))
    early = read()
    assert set(early) < set(want)  # the last periods are open still
    beat(spark, f"{base}/beats", "2030-01-01 00:00:00")
    run()
    assert read() == want
    run()  # a restart adds nothing
    assert read() == want


RECORDS = "record_id string, created_at timestamp_ntz, kind string, filename string, content string"


def log_and_store(source, path):
    return (Flow("both").add("in", "table", frame=source)
            .add("route", "route", auto_terminate=["unmatched"],
                 rules={"large": F.col("kind") == "l", "small": F.col("kind").isin("s", "l2")})
            .add("mark", "update", assignments={"category": F.col("kind")})
            .add("store", "store", path=path, by="category")
            .add("log", "log", columns={"kind": F.col("kind")})
            .connect("in", "route").connect("route", "mark", ["large", "small"]).connect("mark", "store")
            .connect("route", "log", ["small"]))


def records(k):
    return [(f"{k}-{i}", T0 + dt.timedelta(seconds=10 * k + i), kind, f"f{i % 3}", f"v{k}-{i}")
            for i, kind in enumerate(["l", "s", "x", "l", "s", None])]


def test_staged_flow_reads_its_source_once(spark):
    base = work_dir(spark, "staged")
    land(spark, f"{base}/in", records(0), RECORDS)
    flow = log_and_store(spark.read.parquet(f"{base}/in"), f"{base}/store")
    plain, staged = flow.plan(spark), flow.plan(spark, f"{base}/staging")
    for end in ("log", "store"):
        assert sorted(map(str, plain[end].collect())) == sorted(map(str, staged[end].collect()))
        assert all("/staging/route/" in f for f in staged[end].inputFiles())
        plan = staged[end]._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "PartitionFilters: [" in plan and "relationship" in plan


def test_shared_sinks_hold_each_batch_once_after_a_crash(spark, monkeypatch):
    from flowspark.operators.generations import GenerationStore
    base = work_dir(spark, "shared")
    for k in range(3):
        land(spark, f"{base}/in", records(k), RECORDS)
    src = stream_path(spark, f"{base}/in", max_files_per_trigger=1)
    flow = log_and_store(src, f"{base}/store")
    start = lambda: start_shared(flow, spark, f"{base}/staging", f"{base}/cp",
                                 {"log": {"path": f"{base}/log", "format": "text"}}, merge_every=2, available_now=True)
    real, seen = GenerationStore.append, []

    def dies(self, df, batch_id, writer):
        out = real(self, df, batch_id, writer)
        seen.append(batch_id)
        if seen.count(1) == 1:
            raise RuntimeError("after a sink, before the batch's commit")
        return out

    with monkeypatch.context() as m:
        m.setattr(GenerationStore, "append", dies)
        with pytest.raises(Exception, match="after a sink"):
            run_to_end(start())
    run_to_end(start())
    run_to_end(start())  # nothing new
    got = {(r.category, r.filename): r.content for r in store_of(spark, flow, "store").read().collect()}
    assert got == {("l", "f0"): "v2-3", ("s", "f1"): "v2-4"}
    lines = [r.value for r in spark.read.text(f"{base}/log").collect() if r.value.startswith("Logging record ")]
    assert sorted(lines) == sorted(f"Logging record {k}-{i}" for k in range(3) for i in (1, 4))


def test_shared_runner_and_its_checks(spark):
    base = work_dir(spark, "shared_runner")
    land(spark, f"{base}/in", records(0), RECORDS)
    flow = log_and_store(stream_path(spark, f"{base}/in"), f"{base}/store")
    with pytest.raises(ValueError, match="log"):
        start_shared(flow, spark, f"{base}/staging", f"{base}/cp")
    with pytest.raises(ValueError, match="one streaming source"):
        start_shared(log_and_store(spark.read.parquet(f"{base}/in"), "x"), spark, "s", "c")
    r = shared_runner(spark, flow, f"{base}/staging", {"log": {"path": f"{base}/log"}}, available_now=True,
                      checkpoint_root=f"{base}/cps")
    assert r.start() == {"started": ["all"], "already_running": [], "failed": []}
    r.await_all(120)
    assert store_of(spark, flow, "store").read().count() == 2
