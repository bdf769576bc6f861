import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowspark import attr, to_records
from flowspark.functions import equals
from flowspark.operators import (drop_rel, fan_in, fan_out, route, select_rel, unmatched, update,
                                 update_attributes)
from flowspark.plans.presets import route_and_update
from flowspark.sources import intake

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
REQUESTS = [  # the two sample POSTs, one without size, one off the base path
    ("POST", "http://localhost:9999/data?size=large", "Large file content", T0),
    ("POST", "http://localhost:9999/data?size=small", "Small file content", T0),
    ("POST", "http://localhost:9999/data", "no size", T0),
    ("POST", "http://localhost:9999/other?size=small", "off path", T0),
]


def requests_df(spark):
    return spark.createDataFrame(
        [(m, u, {"Content-Type": "text/plain"}, b, t) for m, u, b, t in REQUESTS],
        "method string, url string, headers map<string,string>, body string, received_at timestamp_ntz")


def test_golden_requests_route_and_store(spark):
    recs = intake(requests_df(spark), base_path="data")
    assert recs.count() == 3  # off-path request not taken in
    recs = recs.withColumn("attributes", F.map_concat(
        "attributes", F.create_map(F.lit("filename"), F.lit("f"))))
    rules = {"large": equals(attr("http.query.param.size"), "large"),
             "small": equals(attr("http.query.param.size"), "small")}
    out = route_and_update(recs, rules, filename=attr("filename"), now="2024-05-06 07:08:09",
                           root="/tmp/out")
    rows = sorted((r.category, r.filename, r.directory, r.processing_time, r.content)
                  for r in out.collect())
    assert rows == [("large", "f.large", "/tmp/out/large", "2024-05-06 07:08:09", "Large file content"),
                    ("small", "f.small", "/tmp/out/small", "2024-05-06 07:08:09", "Small file content")]


def test_route_is_partition_when_rules_exclusive(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3))
    rules = {"zero": F.col("v") == 0, "one": F.col("v") == 1}
    matched = route(df, rules).count()
    un = unmatched(df, rules).count()
    assert matched + un == 100
    kept = route(df, rules, keep_unmatched=True)
    assert kept.count() == 100
    assert drop_rel(kept, "zero", "one").count() == un  # nulls are unmatched


def test_multi_match_emits_one_row_per_rule(spark):
    df = spark.createDataFrame([(1, 60.0), (2, 20.0), (3, 1.0)], "id int, value double")
    out = route(df, {"high": F.col("value") > 10, "very_high": F.col("value") > 50})
    got = sorted((r.id, r.relationship) for r in out.collect())
    assert got == [(1, "high"), (1, "very_high"), (2, "high")]
    assert select_rel(out, "very_high").count() == 1


def test_single_pass_equals_filter_union(spark):
    df = spark.range(50).withColumn("k", F.col("id") % 4)
    rules = {"a": F.col("k") == 0, "b": F.col("k") == 1}
    single = route(df, rules).select("id", "relationship")
    branches = fan_out(df, rules)
    union = fan_in(*[update(b, {"relationship": n}) for n, b in branches.items()]).select("id", "relationship")
    assert sorted(single.collect()) == sorted(union.collect())


def test_route_rejects_bad_rules(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        route(df, {})
    with pytest.raises(ValueError):
        route(df, {"unmatched": F.lit(True)})


def test_update_attributes_overwrite_add_remove(spark):
    df = spark.createDataFrame([("1", {"filename": "f", "keep": "k", "gone": "g"})],
                               "record_id string, attributes map<string,string>")
    out = update_attributes(df, {"filename": F.concat(attr("filename"), F.lit(".x")),
                                 "category": attr("keep"), "gone": F.lit(None)})
    assert out.first()["attributes"] == {"filename": "f.x", "keep": "k", "category": "k"}


def test_update_columns_see_input_row(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    out = update(df, {"name": F.lit("b"), "old": F.col("name")}).first()
    assert (out["name"], out["old"]) == ("b", "a")


def test_fan_in_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([(2, True)], "id int, b boolean")
    rows = sorted(fan_in(a, b).collect(), key=lambda r: r.id)
    assert rows[0]["b"] is None and rows[1]["a"] is None


def test_to_records_envelope(spark):
    df = spark.createDataFrame([(7, T0, "héllo", None, "v")], "id long, t timestamp_ntz, c string, n string, s string")
    r = to_records(df, "id", "t", content="c", attributes={"n": F.col("n"), "s": F.col("s")}).first()
    assert r.record_id == "7" and r.size == 6 and r.attributes == {"s": "v"}


def test_intake_methods_and_missing_headers(spark):
    rows = [("GET", "http://h/data?size=large", None, "g", T0),
            ("post", "http://h/data?size=small", None, "p", T0),
            ("POST", "http://h/data/x?size=large&size=small", {"X-A": "1"}, "q", T0)]
    df = spark.createDataFrame(rows, "method string, url string, headers map<string,string>, "
                                     "body string, received_at timestamp_ntz")
    got = {r.content: r.attributes for r in intake(df, base_path="/data", header_regex="X-.*").collect()}
    assert set(got) == {"p", "q"}  # GET is not taken in; method case does not matter
    assert got["p"] == {"http.query.param.size": "small"}
    assert got["q"] == {"X-A": "1", "http.query.param.size": "large"}


def test_route_update_equals_branch_stages_and_scans_once(spark):
    from flowspark.operators import route_update
    from tests.conftest import SF_SMALL
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    rules = {"large": F.col("event_type") == "purchase", "small": F.col("event_type") == "click",
             "big": F.col("value") > 90}
    updates = {"large": {"category": "large", "tag": F.lit("L")},
               "small": {"category": "small"},
               "big": {"category": "big", "value": F.col("value") * 2}}
    single = route_update(ev, rules, updates).select("event_id", "relationship", "category", "tag", "value")
    branches = fan_in(*[update(route(ev, rules).filter(F.col("relationship") == b), a)
                        for b, a in updates.items()]).select("event_id", "relationship", "category",
                                                              "tag", "value")
    assert sorted(single.collect()) == sorted(branches.collect())
    assert single._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    with pytest.raises(ValueError):
        route_update(ev, rules, {"nope": {"x": "y"}})
