import datetime as dt
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from flowspark.operators import counters, route
from flowspark.plans.flow import Flow, stage_type
from flowspark.plans.presets import route_and_update, sample_flow
from flowspark.session import work_dir
from flowspark.sources import generate_stream, schedule
from flowspark.streaming import FlowRunner, run_to_end, start_file_sink, stream_table
from tests.conftest import SF_SMALL


def test_schedule_and_sample_flow(spark):
    firings = schedule(spark, 3, "60 sec", "2024-01-01 00:00:00")
    out = sample_flow(firings, custom_text="Hello from the flow!").plan(spark)["log"]
    rows = sorted(out.collect(), key=lambda r: r.record_id)
    assert [r.record_id for r in rows] == ["0-0", "1-0", "2-0"]
    assert rows[0].line.endswith("Payload: Hello from the flow!")
    times = [r.fired_at for r in firings.orderBy("firing_id").collect()]
    assert times[1] - times[0] == dt.timedelta(seconds=60)


def test_generator_exact_size_and_text_wins(spark):
    firings = schedule(spark, 2)
    flow = Flow().add("g", "generate", firings=firings, batch_size=5, file_size="10KB")
    recs = flow.plan(spark)["g"].collect()
    assert len(recs) == 10 and {r.size for r in recs} == {10240}
    flow = Flow().add("g", "generate", firings=firings, custom_text="hi", file_size="1KB")
    assert {r.size for r in flow.plan(spark)["g"].collect()} == {2}


def test_flow_validation(spark):
    df = spark.range(3)
    with pytest.raises(KeyError):
        Flow().add("a", "no_such_type")
    f = Flow().add("a", "table", frame=df).add("b", "filter", condition=F.col("id") > 0)
    with pytest.raises(ValueError):
        f.connect("a", "b", ["nope"])
    f.connect("a", "b").add("c", "update", assignments={}).connect("b", "c", ["matched"])
    with pytest.raises(ValueError):
        f.plan(spark)  # b's 'unmatched' is neither connected nor auto-terminated
    f.stages["b"].auto_terminate = ("unmatched",)
    assert f.plan(spark)["c"].count() == 2
    cyc = (Flow().add("a", "table", frame=df).add("x", "update", assignments={})
           .add("y", "update", assignments={}).connect("a", "x").connect("x", "y").connect("y", "x"))
    with pytest.raises(ValueError):
        cyc.plan(spark)


def test_custom_stage_type(spark):
    @stage_type("double_id")
    def double(df):
        return df.withColumn("id", F.col("id") * 2)
    out = Flow().add("a", "table", frame=spark.range(3)).add("d", "double_id").connect("a", "d").plan(spark)
    assert sorted(r.id for r in out["d"].collect()) == [0, 2, 4]


def test_stream_generator_one_batch_per_start(spark):
    base = work_dir(spark, "test_gen_stream")
    for n in (1, 2, 3):
        q = start_file_sink(generate_stream(spark, batch_size=5, file_size="1KB"), f"{base}/out",
                            f"{base}/cp", available_now=True)
        run_to_end(q, 120)
        got = spark.read.parquet(f"{base}/out")
        assert got.count() == 5 * n
    times = sorted({r.created_at for r in got.select("created_at").collect()})
    assert len(times) == 3 and times[1] - times[0] == dt.timedelta(seconds=60)


def _routed(df):
    rules = {"large": F.col("event_type") == "purchase", "small": F.col("event_type") == "click"}
    return route_and_update(df, rules, filename=F.col("event_id").cast("string"), now=F.col("ts"))


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    base = work_dir(spark, "test_stream_restart")
    batch = _routed(spark.read.parquet(f"{SF_SMALL}/events.parquet"))
    for _ in range(2):
        s = _routed(stream_table(spark, SF_SMALL, "events", max_files_per_trigger=1))
        run_to_end(start_file_sink(s, f"{base}/out", f"{base}/cp", ["category"], available_now=True), 120)
    stored = spark.read.schema(batch.schema).parquet(f"{base}/out").select(*batch.columns)
    assert stored.count() == batch.count()
    assert stored.exceptAll(batch).count() == 0 and batch.exceptAll(stored).count() == 0


def test_runner_start_stop_status(spark):
    runner = FlowRunner(spark, "t6")
    base = work_dir(spark, "test_runner")

    def starter(name):
        df = counters(generate_stream(spark, batch_size=2, period="1 sec"), "gen_counts")
        w = (df.writeStream.format("parquet").queryName(name)
             .option("checkpointLocation", f"{base}/cp").trigger(processingTime="500 milliseconds"))
        return w.start(f"{base}/out")

    runner.register("gen", starter)
    assert runner.start() == {"started": ["gen"], "already_running": [], "failed": []}
    assert runner.start("gen")["already_running"] == ["gen"]
    q = runner.active()["gen"]
    deadline = time.time() + 60
    while q.lastProgress is None and time.time() < deadline:
        time.sleep(0.5)  # a rate source always has more data: poll, never drain
    st = runner.status()[0]
    assert st["state"] == "RUNNING" and st["name"] == "gen"
    assert runner.stop() == {"stopped": ["gen"], "already_stopped": [], "failed": []}
    assert runner.stop()["already_stopped"] == ["gen"]
    assert runner.status()[0]["state"] == "STOPPED"


def test_batch_counters(spark):
    obs = Observation("flow")
    df = spark.createDataFrame([("a", 3), ("b", 4)], "record_id string, size long")
    counters(route(df, {"all": F.lit(True)}), obs).collect()
    assert obs.get == {"records": 2, "bytes": 7}


def test_flow_runs_as_stream_and_resumes(spark):
    from flowspark.plans.presets import route_and_store_flow
    from flowspark.streaming import flow_runner
    base = work_dir(spark, "test_flow_stream")
    src = stream_table(spark, SF_SMALL, "events")
    rules = {"large": F.col("event_type") == "purchase", "small": F.col("event_type") == "click"}
    flow = route_and_store_flow(src, rules, filename=F.col("event_id").cast("string"), now=F.col("ts"))
    runner = flow_runner(spark, flow, {"store": {"path": f"{base}/out", "partition_by": ["category"]}},
                         available_now=True, checkpoint_root=f"{base}/cp")
    for _ in range(2):  # second start resumes from the checkpoint: nothing new
        assert runner.start()["started"] == ["store"]
        runner.await_all(120)
    batch = route_and_store_flow(spark.read.parquet(f"{SF_SMALL}/events.parquet"), rules,
                                 filename=F.col("event_id").cast("string"), now=F.col("ts"))
    want = batch.plan(spark)["store"]
    got = spark.read.schema(want.schema).parquet(f"{base}/out").select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_byte_cap_splits_batches_without_changing_result(spark):
    from flowspark.streaming import stream_path
    base = work_dir(spark, "test_byte_cap")
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartitionByRange(4, "ts").write.parquet(f"{base}/in")
    with pytest.raises(ValueError):
        stream_path(spark, f"{base}/in", max_files_per_trigger=1, max_bytes_per_trigger="1 KB")
    s = stream_path(spark, f"{base}/in", max_bytes_per_trigger="1 KB")
    q = run_to_end(start_file_sink(s, f"{base}/out", f"{base}/cp", available_now=True), 120)
    batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(batches) >= 2
    assert spark.read.parquet(f"{base}/out").count() == 1000


def test_stream_counters_and_period_trigger(spark):
    from flowspark.plans.flow import Flow
    from flowspark.streaming import flow_runner
    base = work_dir(spark, "test_stream_counters")
    src = counters(generate_stream(spark, batch_size=3, period="1 sec"), "gen_counts")
    flow = Flow("counted").add("src", "table", frame=src).add("sink", "update", assignments={}) \
        .connect("src", "sink")
    runner = flow_runner(spark, flow, {"sink": {"path": f"{base}/out"}}, period="500 milliseconds",
                         checkpoint_root=f"{base}/cp")
    assert runner.start()["started"] == ["sink"]
    q = runner.active()["sink"]
    deadline = time.time() + 60
    while (not q.lastProgress or not q.lastProgress.get("observedMetrics")) and time.time() < deadline:
        time.sleep(0.5)
    observed = runner.status()[0]["observed"]["gen_counts"]
    assert observed["records"] == 3 and observed["bytes"] == 3 * 1024
    runner.stop()


def test_store_stream_replay_is_idempotent(spark):
    from flowspark.operators import latest, read_store
    from flowspark.streaming import store_stream
    base = work_dir(spark, "test_store_stream")
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        F.col("event_type").alias("d"), (F.col("user_id") % 7).cast("string").alias("f"),
        "event_id", F.col("ts").alias("created_at"))
    order = ["created_at", "event_id"]
    for cp in ("cp1", "cp2"):  # the second run replays every batch into the same store
        s = stream_table(spark, SF_SMALL, "events").select(
            F.col("event_type").alias("d"), (F.col("user_id") % 7).cast("string").alias("f"),
            "event_id", F.col("ts").alias("created_at"))
        run_to_end(store_stream(s, f"{base}/store", "d", "f", f"{base}/{cp}", order=order,
                                available_now=True), 120)
    got = read_store(spark, f"{base}/store", "d", "f", order=order).select("d", "f", "event_id")
    want = latest(events, ["d", "f"], order).select("d", "f", "event_id")
    assert sorted(got.collect()) == sorted(want.collect())


def test_flow_from_spec_equals_preset(spark):
    from flowspark.plans.catalog import ROUTE_AND_STORE_SPEC
    from flowspark.plans.flow import Flow
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    got = Flow.from_spec(ROUTE_AND_STORE_SPEC, {"events": events}).plan(spark)["store"]
    rules = {"large": F.col("event_type") == "purchase", "small": F.col("event_type") == "click"}
    want = route_and_update(events, rules, filename=F.col("event_id").cast("string"), now=F.col("ts"))
    cols = ["event_id", "category", "processing_time", "filename", "directory"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


def test_read_log_whole_file(spark):
    from flowspark.sources import read_log
    base = work_dir(spark, "test_read_log")
    spark.createDataFrame([("a\nb",), ("c",)], "line string").coalesce(1).write.text(base)
    assert read_log(spark, base).count() == 3
    assert read_log(spark, base, whole_file=True).first()["value"] == "a\nb\nc\n"


def test_sample_flow_runs_as_stream_into_a_text_log(spark):
    from flowspark.sources import read_log, schedule_stream
    base = work_dir(spark, "test_sample_stream")
    flow = sample_flow(schedule_stream(spark, batch_size=1, period="60 sec"),
                       custom_text="Hello from the flow!")
    runner = flow.runner(spark, {"log": {"path": f"{base}/log", "format": "text"}},
                         available_now=True, checkpoint_root=f"{base}/cp")
    for _ in range(3):  # one firing per start
        runner.start()
        runner.await_all(120)
    lines = [r.value for r in read_log(spark, f"{base}/log").collect()]
    assert lines.count("Payload: Hello from the flow!") == 3
    assert sorted(v for v in lines if v.startswith("Logging record ")) == [
        "Logging record 0-0", "Logging record 1-0", "Logging record 2-0"]


def test_connection_expiration(spark):
    rows = [(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9))]
    df = spark.createDataFrame(rows, "id int, created_at timestamp_ntz")
    f = (Flow().add("a", "table", frame=df).add("b", "update", assignments={})
         .connect("a", "b", expiration="7 days", now="2024-01-10 00:00:00"))
    assert [r.id for r in f.plan(spark)["b"].collect()] == [2]
    keep_all = (Flow().add("a", "table", frame=df).add("b", "update", assignments={})
                .connect("a", "b", expiration="0 sec"))
    assert keep_all.plan(spark)["b"].count() == 2
    with pytest.raises(ValueError):
        Flow().add("a", "table", frame=df).add("b", "update", assignments={}).connect(
            "a", "b", expiration="soon")


def test_flow_describe(spark):
    from flowspark.plans.catalog import ROUTE_AND_STORE_SPEC
    from flowspark.plans.flow import Flow
    flow = Flow.from_spec(ROUTE_AND_STORE_SPEC, {"events": spark.range(1)})
    rows = {r["name"]: r for r in flow.describe()}
    assert rows["route"]["relationships"] == ["large", "small", "unmatched"]
    assert rows["route"]["auto_terminate"] == ["unmatched"]
    assert rows["store"]["inputs"] == ["update_large", "update_small"]
    assert all(r["state"] is None for r in rows.values())


def test_store_stream_survives_a_crash_before_commit(spark):
    from flowspark.operators import latest, read_store
    from flowspark.streaming import store_stream, stream_path
    base = work_dir(spark, "test_store_crash")
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartitionByRange(4, "ts").write.parquet(f"{base}/in")
    cols = [F.col("event_type").alias("d"), (F.col("user_id") % 5).cast("string").alias("f"),
            "event_id", F.col("ts").alias("created_at")]
    order = ["created_at", "event_id"]
    crashed = []

    def crash_once(batch_id):
        if batch_id == 1 and not crashed:
            crashed.append(batch_id)
            raise RuntimeError("lost before commit")

    src = stream_path(spark, f"{base}/in", max_files_per_trigger=1).select(*cols)
    q = store_stream(src, f"{base}/store", "d", "f", f"{base}/cp", order=order, available_now=True,
                     after_batch=crash_once)
    with pytest.raises(Exception):
        run_to_end(q, 120)
    src = stream_path(spark, f"{base}/in", max_files_per_trigger=1).select(*cols)
    run_to_end(store_stream(src, f"{base}/store", "d", "f", f"{base}/cp", order=order,
                            available_now=True), 120)  # restart: batch 1 is replayed
    got = read_store(spark, f"{base}/store", "d", "f", order=order).select("d", "f", "event_id")
    want = latest(spark.read.parquet(f"{base}/in").select(*cols), ["d", "f"], order).select("d", "f", "event_id")
    assert crashed == [1]
    assert sorted(got.collect()) == sorted(want.collect())


def test_more_stage_types(spark):
    from flowspark.plans.flow import Flow
    recs = spark.createDataFrame(
        [("1", dt.datetime(2024, 1, 9), "token = abc", "p1"), ("2", dt.datetime(2024, 1, 1), "x", "p2")],
        "record_id string, created_at timestamp_ntz, content string, pid string")
    names = spark.createDataFrame([("p1", "Gen")], "id string, name string")
    flow = (Flow().add("in", "table", frame=recs)
            .add("fresh", "expire", ttl="7 days", now="2024-01-10 00:00:00")
            .add("clean", "redact", column="content")
            .add("named", "lookup", names=names, left_key="pid", right_key="id", columns=["name"])
            .add("log", "log", payload=True, columns={"name": F.col("name")})
            .connect("in", "fresh").connect("fresh", "clean").connect("clean", "named")
            .connect("named", "log"))
    out = flow.plan(spark)["log"].collect()
    assert [r.record_id for r in out] == ["1"]
    assert out[0].line == ("Logging record 1\nRecord attributes\nKey: 'name'\n  Value: 'Gen'\n"
                           "Payload: token = ***")


def test_run_to_end_stops_a_stream_that_does_not_finish(spark):
    base = work_dir(spark, "test_run_to_end")
    q = start_file_sink(generate_stream(spark, period="1 sec"), f"{base}/out", f"{base}/cp",
                        period="1 sec")
    with pytest.raises(TimeoutError):
        run_to_end(q, 2)
    assert not q.isActive


def test_queue_depth_stream_grows_and_throttles(spark):
    from flowspark.streaming import latest_depth, queue_depth_stream, start_snapshot_sink, stream_path
    base = work_dir(spark, "test_queue_depth")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.repartitionByRange(4, "ts").write.parquet(f"{base}/in")
    s = stream_path(spark, f"{base}/in", max_files_per_trigger=1)
    depth = queue_depth_stream(s, "event_type", F.octet_length("props"), max_objects=150, max_bytes="1 MB")
    run_to_end(start_snapshot_sink(depth, f"{base}/snap", f"{base}/cp", available_now=True), 120)
    snaps = spark.read.parquet(f"{base}/snap")
    assert snaps.select("batch_id").distinct().count() == 4
    click = [r.total_objects for r in snaps.filter(F.col("queue") == "click").orderBy("batch_id").collect()]
    assert click == sorted(click) and len(click) == 4
    final = {r.queue: (r.total_objects, r.limit_reached) for r in latest_depth(spark, f"{base}/snap").collect()}
    want = {r.event_type: r["count"] for r in ev.groupBy("event_type").count().collect()}
    assert {q: n for q, (n, _) in final.items()} == want
    assert all(t == (want[q] >= 150) for q, (_, t) in final.items())


def test_streamed_period_counts_give_the_batch_spikes(spark):
    from flowspark.operators import error_rate_spike, rate_spikes
    from flowspark.streaming import error_counts_stream
    base = work_dir(spark, "test_error_periods")
    src = stream_table(spark, SF_SMALL, "events").select("ts", "event_type")
    periods = error_counts_stream(src, "ts", F.col("event_type") == "error", "1 hour", "30 minutes")
    run_to_end(start_file_sink(periods, f"{base}/out", f"{base}/cp", available_now=True), 120)
    stored = spark.read.schema(periods.schema).parquet(f"{base}/out")
    got = rate_spikes(stored, "1 hour", 3, 0.05)
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    want = error_rate_spike(ev, "ts", F.col("event_type") == "error", "1 hour", 3, 0.05)
    closed = [r.period_start for r in stored.select("period_start").collect()]
    assert len(closed) > 100
    assert sorted(got.collect()) == sorted(want.filter(F.col("period_start").isin(closed)).collect())
