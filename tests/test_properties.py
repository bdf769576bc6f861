"""Property tests (hypothesis): many random small inputs per Spark job."""

import datetime as dt
from urllib.parse import unquote

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowspark.functions import data_size_bytes, duration_ms, parse_data_size, parse_duration, query_params
from flowspark.operators import latest, log_lines, parse_log, route, unmatched

SETTINGS = settings(max_examples=15, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
T0 = dt.datetime(2024, 1, 1)

text = st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="'\r"), max_size=12)
attr_key = st.text(alphabet="abcdefghijklmnopqrstuvwxyz._-", min_size=1, max_size=8)


@SETTINGS
@given(st.lists(st.tuples(st.dictionaries(attr_key, text, max_size=4), st.one_of(st.none(), text)),
                min_size=1, max_size=6))
def test_log_round_trip(spark, records):
    rows = [(str(i), T0, attrs, payload) for i, (attrs, payload) in enumerate(records)]
    df = spark.createDataFrame(rows, "record_id string, created_at timestamp_ntz, "
                                     "attributes map<string,string>, content string")
    back = {r.record_id: (r.attributes, r.content) for r in parse_log(log_lines(df, payload=True)).collect()}
    for rid, _, attrs, payload in rows:
        assert back[rid] == (attrs, payload or "")


def py_params(query: str) -> dict:
    out = {}
    for part in query.split("&"):
        if not part:
            continue
        k, eq, v = part.partition("=")
        k, v = unquote(k), unquote(v) if eq else ""
        out.setdefault(k, v)
    return out


param_text = st.text(alphabet="abcxyz019_=", max_size=6)


@SETTINGS
@given(st.lists(st.lists(param_text, max_size=5).map("&".join), min_size=1, max_size=8))
def test_query_params_first_value_wins(spark, queries):
    urls = [(f"http://h/p?{q}#f",) for q in queries]
    got = [r[0] for r in spark.createDataFrame(urls, "u string").select(query_params("u", prefix="")).collect()]
    assert got == [py_params(q) for q in queries]


size_text = st.builds(lambda n, sp, u: f"{n}{sp}{u}", st.integers(0, 5000), st.sampled_from(["", " "]),
                      st.sampled_from(["", "B", "KB", "kb", "MB", "GB", "sec", "min", "hours", "ms", "x"]))


@SETTINGS
@given(st.lists(size_text, min_size=1, max_size=10))
def test_parsers_match_driver_twins(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(parse_data_size("t").alias("b"), parse_duration("t").alias("d")).collect()
    assert [r.b for r in rows] == [data_size_bytes(t) for t in texts]
    assert [r.d for r in rows] == [duration_ms(t) for t in texts]


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(0, 5)), min_size=1, max_size=30))
def test_route_partition_and_single_pass(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int")
    rules = {"low": F.col("v") < 2, "mid": (F.col("v") >= 2) & (F.col("v") < 4)}
    routed = route(df, rules)
    un = unmatched(df, rules)
    assert routed.count() + un.count() == len(values)
    by_filter = sorted((r.id, n) for n, c in rules.items() for r in df.filter(c).collect())
    assert sorted((r.id, r.relationship) for r in routed.collect()) == by_filter


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xy"), st.integers(0, 3)), min_size=1, max_size=20))
def test_latest_idempotent_and_maximal(spark, rows):
    df = spark.createDataFrame([(d, f, T0 + dt.timedelta(seconds=s), i) for i, (d, f, s) in enumerate(rows)],
                               "d string, f string, created_at timestamp_ntz, id long")
    once = latest(df, ["d", "f"], ["created_at", "id"])
    twice = latest(once.unionByName(df), ["d", "f"], ["created_at", "id"])
    assert sorted(once.collect()) == sorted(twice.collect())
    want = {}
    for i, (d, f, s) in enumerate(rows):
        if (d, f) not in want or (s, i) > want[(d, f)]:
            want[(d, f)] = (s, i)
    assert {(r.d, r.f): r.id for r in once.collect()} == {k: v[1] for k, v in want.items()}


@settings(max_examples=10, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 1200))),
                min_size=1, max_size=40),
       st.integers(0, 3))
def test_threshold_alert_matches_brute_force(spark, rows, more_than):
    from flowspark.operators import threshold_alert
    data = [(i, k, None if s is None else T0 + dt.timedelta(seconds=s)) for i, (k, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, k string, ts timestamp_ntz")
    want = {}
    for i, k, t in data:  # SQL: RANGE 300 s PRECEDING per key; null times are peers
        peers = [u for j, kk, u in data if kk == k]
        n = sum(1 for u in peers if u is None) if t is None else \
            sum(1 for u in peers if u is not None and t - dt.timedelta(seconds=300) <= u <= t)
        if n > more_than:
            want[i] = n
    got = {r.id: r.n_recent for r in threshold_alert(df, "k", "ts", "5 minutes", more_than).collect()}
    assert got == want


@SETTINGS
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.sampled_from(["x", "y", None])),
                min_size=1, max_size=25))
def test_route_update_equals_stage_per_branch(spark, rows):
    from flowspark.operators import fan_in, route_update, update
    df = spark.createDataFrame([(i, v, t) for i, (v, t) in enumerate(rows)], "id int, v int, t string")
    rules = {"low": F.col("v") < 5, "x": F.col("t") == "x", "odd": F.col("v") % 2 == 1}
    updates = {"low": {"tag": "low", "v": F.col("v") + 100}, "x": {"tag": F.upper("t")}, "odd": {}}
    single = route_update(df, rules, updates)
    staged = fan_in(*[update(route(df, rules).filter(F.col("relationship") == b), updates.get(b, {}))
                      for b in rules])
    cols = ["id", "relationship", "v", "t", "tag"]
    assert sorted(single.select(cols).collect(), key=repr) == sorted(staged.select(cols).collect(), key=repr)
