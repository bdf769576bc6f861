import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import GenerationStore
from flowspark.session import work_dir
from flowspark.streaming import run_to_end, start_batches, stream_path

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "record_id string, created_at timestamp_ntz, category string, filename string, content string"


def rows(spark, *items):
    """(id, second, category, filename, content) tuples as records."""
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), c, f, v) for i, s, c, f, v in items], SCHEMA)


def new(spark, name):
    return GenerationStore(spark, work_dir(spark, name), "category", "filename")


def held(store, *directories):
    got = store.read(list(directories) or None)
    rows_ = [] if got is None else got.collect()
    out = {(r.category, r.filename): r.content for r in rows_}
    assert len(out) == len(rows_)
    return out


def test_deliveries_merges_and_reads(spark):
    s = new(spark, "gen_basic")
    assert s.read() is None and s.merge() is None and s.vacuum() == []
    rejects = s.append(rows(spark, ("1", 0, "a", "x", "a1"), ("2", 0, "b", "x", "b1"), ("3", 0, None, "x", "n"),
                            ("4", 0, "", "x", "e"), ("5", 0, "b", None, "f")), 0)
    assert sorted(r.record_id for r in rejects.collect()) == ["3", "4", "5"]
    assert held(s) == {("a", "x"): "a1", ("b", "x"): "b1"}
    assert s.merge() == 1 and held(s) == {("a", "x"): "a1", ("b", "x"): "b1"}
    s.append(rows(spark, ("6", 5, "b", "x", "b2"), ("7", 5, "c", "y", "c1")), 1)
    want = {("a", "x"): "a1", ("b", "x"): "b2", ("c", "y"): "c1"}
    assert held(s) == want and held(s, "b", "zz") == {("b", "x"): "b2"}
    assert s.merge() == 2 and s.merge() == 2 and held(s) == want
    s.append(rows(spark, ("8", 1, "b", "x", "older")), 2)  # comes late, is older: replaces nothing
    assert held(s) == want and s.merge() == 3 and held(s) == want
    manifest = {r.category: r.holder for r in s._manifest(s.state()).collect()}
    assert manifest == {"a": 1, "b": 3, "c": 2}  # only touched directories moved


def test_a_delivery_is_stored_once(spark):
    s = new(spark, "gen_replay")
    first = rows(spark, ("1", 0, "a", "x", "a1"))
    s.append(first, 0)
    s.append(first, 0)
    assert s.state().pending == ["batch-0"]
    s.merge()
    s.append(first, 0)  # again after the merge
    assert s.state().pending == [] and held(s) == {("a", "x"): "a1"}
    s.append(rows(spark, ("2", 0, "a", "y", "other")), 0, writer="other/stream")  # same number, another writer
    assert s.state().pending == ["other-stream-0"] and len(held(s)) == 2


def test_crashes_before_a_commit_leave_no_trace(spark, monkeypatch):
    s = new(spark, "gen_crash")
    s.append(rows(spark, ("1", 0, "a", "x", "a1")), 0)
    s.merge()

    def crash(*a):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(GenerationStore, "_commit", crash)
        with pytest.raises(RuntimeError):
            s.append(rows(spark, ("2", 9, "a", "x", "half"), ("3", 9, "zz", "x", "half")), 1)
    assert held(s) == {("a", "x"): "a1"}
    s.append(rows(spark, ("2", 9, "a", "x", "a2")), 1)  # the run that succeeds overwrites its folder
    assert held(s) == {("a", "x"): "a2"}
    with monkeypatch.context() as m:
        m.setattr(GenerationStore, "_commit", crash)
        with pytest.raises(RuntimeError):
            s.merge()
    assert held(s) == {("a", "x"): "a2"} == held(s, "a") and s.state().generation == 1
    assert s.merge() == 2 and held(s) == {("a", "x"): "a2"}


def test_one_directory_scans_its_live_folder_only(spark):
    s = new(spark, "gen_prune")
    for k in range(3):
        s.append(rows(spark, *[(f"{k}{d}", k, d, f"f{k}", "v") for d in ("a", "b", "c")]), k)
        s.merge()
    got = s.read(["b"])
    assert {r.filename for r in got.collect()} == {"f0", "f1", "f2"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "PartitionFilters: [" in plan
    assert "generation" in plan and "= 3)" in plan and "category" in plan
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == scan.metrics().apply("numPartitions").value() == 1


def test_vacuum_keeps_what_is_read(spark):
    s = new(spark, "gen_vacuum")
    s.append(rows(spark, ("1", 0, "a", "x", "a1"), ("2", 0, "b", "x", "b1")), 0)
    s.merge()
    s.append(rows(spark, ("3", 1, "a", "x", "a2")), 1)
    s.merge()
    s.append(rows(spark, ("4", 2, "a", "y", "a3"), ("5", 2, "b", "x", "b2")), 2)
    before = held(s)
    assert s.vacuum() == ["batches/delivery=batch-0", "batches/delivery=batch-1", "manifest/generation=1"]
    assert held(s) == before
    s.merge()
    assert "data/generation=1" in s.vacuum() and held(s) == before
    s.append(rows(spark, ("3", 1, "a", "x", "a2")), 1)
    assert held(s) == before


def test_names_as_written_empty_deliveries_new_columns_and_clashes(spark):
    s = new(spark, "gen_names")
    s.append(rows(spark), 0)
    assert held(s) == {} and s.merge() == 1 and held(s) == {} == held(s, "a")
    s.append(rows(spark, ("1", 0, "01", "x", "v"), ("2", 0, "1", "x", "w"), ("3", 0, "a b/ü=%", "x", "u")), 1)
    s.merge()
    assert held(s, "01") == {("01", "x"): "v"} and held(s, "a b/ü=%") == {("a b/ü=%", "x"): "u"}
    s.append(rows(spark, ("4", 1, "1", "z", "t")).withColumn("extra", F.lit(7)), 2)
    got = {(r.category, r.filename): r.extra for r in s.read().collect()}
    assert got == {("01", "x"): None, ("1", "x"): None, ("a b/ü=%", "x"): None, ("1", "z"): 7}
    with pytest.raises(ValueError, match="generation"):
        s.append(rows(spark).withColumn("generation", F.lit(1)), 3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_course_of_events_equals_the_replayed_log(spark, seed):
    """Random deliveries, repeats, merges and vacuums against a dictionary."""
    rnd, s = random.Random(seed), new(spark, "gen_random")
    want, done = {}, []
    for k in range(5):
        items = [(f"{k}-{j}", rnd.randrange(20), rnd.choice("ab"), rnd.choice("xyz"), f"v{k}-{j}") for j in range(rnd.randrange(5))]
        s.append(rows(spark, *items), k)
        done.append(items)
        for i, sec, c, f, v in items:
            if (c, f) not in want or (sec, i) > want[c, f][:2]:
                want[c, f] = (sec, i, v)
        if rnd.random() < 0.4:
            old = rnd.randrange(k + 1)
            s.append(rows(spark, *done[old]), old)
        if rnd.random() < 0.5:
            s.merge()
        if rnd.random() < 0.3:
            s.vacuum()
    assert held(s) == {key: v for key, (_, _, v) in want.items()}


def test_stream_sink_restarts_without_loss_or_repeats(spark):
    base, s = work_dir(spark, "gen_stream"), new(spark, "gen_stream_store")
    landing = f"{base}/in"
    crashed = []

    def start(write):
        q = start_batches(stream_path(spark, landing, max_files_per_trigger=1), write, f"{base}/cp", available_now=True)
        run_to_end(q)

    rows(spark, ("1", 0, "a", "x", "a1")).coalesce(1).write.mode("append").parquet(landing)
    rows(spark, ("2", 1, "a", "x", "a2")).coalesce(1).write.mode("append").parquet(landing)
    sink = s.sink("s", merge_every=2)

    def dies(batch, batch_id):
        sink(batch, batch_id)
        if batch_id == 1:
            crashed.append(batch_id)
            raise RuntimeError("after the store, before the stream's commit")

    with pytest.raises(Exception, match="after the store"):
        start(dies)
    assert crashed == [1] and s.state().generation == 1
    start(sink)  # batch 1 is run again and is known
    rows(spark, ("3", 2, "b", "x", "b1")).coalesce(1).write.mode("append").parquet(landing)
    start(sink)
    assert held(s) == {("a", "x"): "a2", ("b", "x"): "b1"}
    assert s.state().generation == 1 and s.state().pending == ["s-2"]
