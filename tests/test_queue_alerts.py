import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from flowspark.operators import (error_rate_spike, expire, expiry_warning, older_than,
                                 prioritize, queue_pressure, running_totals, threshold_alert)

T0 = dt.datetime(2024, 1, 1)


def skewed_events(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 else rnd.choice(["a", "b", None])  # one key holds 2/3 of rows
        t = T0 + dt.timedelta(seconds=rnd.randint(0, 6 * 3600))
        rows.append((i, key, t, rnd.randint(0, 100)))
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, size long")


def test_running_totals_match_window_with_hot_key(spark):
    df = skewed_events(spark)
    got = running_totals(df, ["k"], ["ts", "id"], {"n": F.lit(1), "b": F.col("size")}, slices=7)
    pdf = df.toPandas().sort_values(["ts", "id"])
    pdf["kk"] = pdf["k"].fillna("<null>")
    pdf["n"] = pdf.groupby("kk").cumcount() + 1
    pdf["b"] = pdf.groupby("kk")["size"].cumsum()
    want = {r.id: (r.n, r.b) for r in pdf.itertuples()}
    assert {r.id: (r.n, r.b) for r in got.collect()} == want


def test_running_totals_without_key(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    got = {r.id: r.s for r in running_totals(df, [], ["id"], {"s": "v"}, slices=5).collect()}
    acc, want = 0, {}
    for i in range(500):
        acc += i % 7
        want[i] = acc
    assert got == want


def test_running_totals_of_signed_values(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, "b").otherwise("hot").alias("k"),
                                 F.when(F.col("id") % 2 == 0, 1).otherwise(-5).alias("v"))
    got = {r.id: r.s for r in running_totals(df, ["k"], ["id"], {"s": "v"}, slices=6).collect()}
    acc, want = {}, {}
    for i in range(400):
        k = "b" if i % 3 == 0 else "hot"
        acc[k] = acc.get(k, 0) + (1 if i % 2 == 0 else -5)
        want[i] = acc[k]
    assert got == want


def test_queue_pressure_flags(spark):
    df = spark.createDataFrame([(i, "q", T0 + dt.timedelta(seconds=i), 400) for i in range(5)],
                               "id long, queue string, ts timestamp_ntz, size long")
    out = {r.id: r for r in queue_pressure(df, "queue", ["ts", "id"], "size", max_objects=4,
                                           max_bytes="1KB").collect()}
    assert [out[i].total_objects for i in range(5)] == [1, 2, 3, 4, 5]
    assert [out[i].limit_reached for i in range(5)] == [False, False, True, True, True]


def test_expire(spark):
    df = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(days=8))], "id int, created_at timestamp_ntz")
    assert expire(df, "0 sec") is df
    got = [r.id for r in expire(df, "7 days", now="2024-01-10 00:00:00").collect()]
    assert got == [2]


def test_prioritize(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 9.0)], "id int, v double")
    assert prioritize(df) is df
    assert [r.id for r in prioritize(df, F.col("v").desc()).collect()] == [2, 1]


def brute_threshold(pdf, period_s, more_than):
    out = {}
    for key, g in pdf.groupby(pdf["k"].fillna("<null>")):
        ts = g["ts"].tolist()
        for i, t in zip(g["id"], ts):
            n = sum(1 for u in ts if t - pd.Timedelta(seconds=period_s) <= u <= t)
            if n > more_than:
                out[i] = n
    return out


def test_threshold_alert_matches_brute_force(spark):
    df = skewed_events(spark, n=1500)
    want = brute_threshold(df.toPandas(), 300, 5)
    assert want  # the hot key does alert
    got = {r.id: r.n_recent for r in threshold_alert(df, "k", "ts", "5 minutes", 5).collect()}
    assert got == want
    pdf = df.toPandas().assign(k="all")
    want_all = brute_threshold(pdf, 300, 5)
    got = {r.id: r.n_recent for r in threshold_alert(df, None, "ts", "5 minutes", 5).collect()}
    assert got == want_all


def test_threshold_alert_ties_and_columns(spark):
    rows = [(i, "a", T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 0, 0, 300, 300, 301, 900])]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
    got = threshold_alert(df, "k", "ts", "5 minutes", 2)
    assert got.columns == ["id", "k", "ts", "n_recent"]
    assert {r.id: r.n_recent for r in got.collect()} == {0: 3, 1: 3, 2: 3, 3: 5, 4: 5, 5: 3}


def test_error_rate_spike(spark):
    rows = [(T0 + dt.timedelta(hours=h, minutes=m), "error" if (h == 4 and m < 30) or m == 0 else "ok")
            for h in range(6) for m in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string")
    out = {r.period_start.hour: r for r in
           error_rate_spike(df, "ts", F.col("kind") == "error", "1 hour", 3, 0.05).collect()}
    assert out[0].trailing_rate is None and not out[0].is_spike
    assert out[4].is_spike and out[4].prior_events == 36
    assert not out[5].is_spike


def test_expiry_warning_and_age(spark):
    df = spark.createDataFrame([(1, T0 + dt.timedelta(days=10)), (2, T0 + dt.timedelta(days=40)),
                                (3, T0 - dt.timedelta(days=1))], "id int, exp timestamp_ntz")
    out = expiry_warning(df, "exp", "30 days", now="2024-01-01 00:00:00").collect()
    assert [(r.id, r.days_left) for r in out] == [(1, 10)]
    flags = df.select(older_than("exp", "8 hours", now="2024-01-01 00:00:00").alias("f")).collect()
    assert [r.f for r in flags] == [False, False, True]


def test_threshold_alert_null_times_are_peers(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "a", None), (4, "a", T0), (5, "b", None)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
    got = {r.id: r.n_recent for r in threshold_alert(df, "k", "ts", "5 minutes", 0).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 1, 5: 1}  # SQL RANGE frame: null order keys are peers


def test_error_rate_spike_null_time_is_its_own_period(spark):
    rows = [(T0, "error"), (T0 + dt.timedelta(hours=1), "ok"), (None, "error"), (None, "ok")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string")
    out = {r.period_start: r for r in error_rate_spike(df, "ts", F.col("kind") == "error").collect()}
    assert (out[None].n_events, out[None].n_errors, out[None].prior_events) == (2, 1, 0)
    assert out[T0 + dt.timedelta(hours=1)].prior_events == 1



def test_running_totals_order_by_any_kind_of_column(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.choice([None, "a", "ü", ""]), rnd.choice([True, False, None]), rnd.choice([None, 1.5, -2.0, float("inf")]),
             dt.date(2024, 1, rnd.randint(1, 28)), T0 + dt.timedelta(seconds=rnd.randint(0, 9)), rnd.randint(-5, 5))
            for i in range(600)]
    df = spark.createDataFrame(rows, "id long, s string, b boolean, d double, day date, ts timestamp, __v long").withColumn(
        "m", (F.col("id") % 7).cast("decimal(9,2)"))
    order = ["s", "b", "d", "day", "ts", "m", "id"]
    sql = "SELECT id, sum(`__v`) OVER (PARTITION BY b ORDER BY {} ROWS UNBOUNDED PRECEDING) AS t FROM rows_of_any_kind"
    df.createOrReplaceTempView("rows_of_any_kind")
    want = {r.id: r.t for r in spark.sql(sql.format(", ".join(order))).collect()}
    for n in (1, 9, 150):  # 150 bounds are looked up in two steps
        got = running_totals(df, ["b"], order, {"t": "__v"}, slices=n)
        assert got.columns == [*df.columns, "t"]
        assert {r.id: r.t for r in got.collect()} == want


def test_running_totals_shuffle_rows_once_in_even_slices(spark):
    from flowspark.operators import prefix
    df = skewed_events(spark, n=20000)  # two thirds are one key's
    out = running_totals(df, ["k"], ["ts", "id"], {"n": F.lit(1)}, slices=40)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "Join" not in plan and "rangepartitioning" not in plan
    places = [prefix.sortable(df, c) for c in ("k", "ts", "id")]
    at = F.struct(*[c.alias(f"c{i}") for i, (c, _) in enumerate(places)])
    bounds = prefix.slice_bounds(df.select(at.alias("at")), 40)
    sizes = [r["count"] for r in df.groupBy(prefix.slice_of(at, [k for _, k in places], bounds).alias("s")).count().collect()]
    assert len(sizes) == 40 and max(sizes) < 3 * 20000 / 40


def test_running_totals_of_no_rows(spark):
    df = skewed_events(spark, n=10).limit(0)
    assert running_totals(df, ["k"], ["ts", "id"], {"n": F.lit(1)}).collect() == []


def test_threshold_alert_leaves_columns_of_any_name_alone(spark):
    df = skewed_events(spark, n=600).selectExpr("*", "5 AS __id", "6 AS __us", "7 AS __n", "8 AS __k", "9 AS n", "k AS us")
    got = threshold_alert(df, "k", "ts", "10 minutes", 8)
    assert got.columns == [*df.columns, "n_recent"]
    rows = got.collect()
    assert {(r["__id"], r["__us"], r["__n"], r["__k"], r.n) for r in rows} == {(5, 6, 7, 8, 9)}
    assert {r.id: r.n_recent for r in rows} == brute_threshold(df.toPandas(), 600, 8)


def test_threshold_alert_bursts_repeats_and_missing_times(spark):
    rows = [(1, "a", T0)] * 50 + [(2, "a", T0 + dt.timedelta(seconds=60))] * 3 + [(3, None, T0), (4, "b", None), (5, "b", None)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
    got = threshold_alert(df, "k", "ts", "1 minute", 1).groupBy("id").agg(
        F.count("*").alias("rows"), F.max("n_recent").alias("n")).collect()
    assert {(r.id, r.rows, r.n) for r in got} == {(1, 50, 50), (2, 3, 53), (4, 1, 2), (5, 1, 2)}
