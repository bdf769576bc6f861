from pyspark.sql import functions as F

from flowspark.operators import (classify, listing_text, lookup, project_listing, scan_listing,
                                 status_positions, status_summary, transition)

LISTING = ('{"processors": [{"id": "p1", "revision": {"version": 3}, "component": '
           '{"name": "Gen", "type": "org.example.stage.Generate", "state": "RUNNING"}}, '
           '{"id": "p2", "revision": {"version": 1}, "component": '
           '{"name": "Log", "type": "org.example.stage.Log", "state": "STOPPED"}}]}')


def test_listing_two_items_empty_and_absent(spark):
    df = spark.createDataFrame([(1, LISTING), (2, '{"processors": []}'), (3, "{}")], "n int, body string")
    items = project_listing(scan_listing(df, "body", keep=["n"]), keep=["n"]).collect()
    assert [(r.n, r.id, r.short_type, r.state, r.version) for r in items] == [
        (1, "p1", "Generate", "RUNNING", 3), (1, "p2", "Log", "STOPPED", 1)]
    text = spark.createDataFrame([("p1", "Gen", "t", "RUNNING")], "a string, b string, c string, d string") \
        .select(listing_text(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert text == "ID: p1\nName: Gen\nType: t\nState: RUNNING"


def test_transition_and_summary_include_zero_classes(spark):
    df = spark.createDataFrame([("a", "RUNNING"), ("b", "STOPPED"), ("c", "STOPPED")], "id string, state string")
    t = transition(df, "state", "RUNNING")
    s = status_summary(t, "outcome", ["started", "already_running", "failed"]).first()
    assert (s.n_started, s.n_already_running, s.n_failed, s.n_total) == (2, 1, 0, 3)
    stop = df.select(classify(F.col("state"), "STOPPED").alias("o")).collect()
    assert [r.o for r in stop] == ["stopped", "already_stopped", "already_stopped"]


def test_status_positions_sorted_per_class(spark):
    df = spark.createDataFrame([(i, "big" if i % 4 else "small") for i in range(200)], "id int, outcome string")
    got = sorted((r.outcome, r.position, r.id) for r in status_positions(df, "outcome", "id").collect())
    big = [i for i in range(200) if i % 4]
    small = [i for i in range(200) if not i % 4]
    want = sorted([("big", p + 1, i) for p, i in enumerate(big)] + [("small", p + 1, i) for p, i in enumerate(small)])
    assert got == want


def test_lookup_left_join_keeps_unknown_ids(spark):
    ids = spark.createDataFrame([("p1",), ("zz",)], "pid string")
    names = spark.createDataFrame([("p1", "Gen")], "id string, name string")
    got = sorted(lookup(ids, names, "pid", "id", ["name"]).collect(), key=lambda r: r.pid)
    assert [(r.pid, r.name) for r in got] == [("p1", "Gen"), ("zz", None)]
