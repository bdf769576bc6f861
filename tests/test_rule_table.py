"""Rules as a table against every rule tried on every record, and requests taken once."""

import random

from pyspark.sql import functions as F

from flowspark.operators import condition_counts, fan_in, route_by_table, rule_index, unmatched_by_table
from flowspark.session import work_dir
from flowspark.sources import intake, intake_once, read_requests
from flowspark.streaming import run_to_end, start_file_sink

RULES = "rule string, attribute string, value string"
RECORDS = "id long, attributes map<string,string>, attribute string, rule string, relationship string"


def brute(records, rules):
    by_rule = {}
    for rule, a, v in rules:
        if rule is not None:
            by_rule.setdefault(rule, set()).add((a, v))
    out = []
    for r in records:
        held = {(k, v) for k, v in (r[1] or {}).items() if v is not None}
        out += [(r[0], rule) for rule, asked in by_rule.items() if asked <= held]
    return sorted(out, key=repr)


def routed(spark, records, rules, counted):
    df, table = spark.createDataFrame(records, RECORDS), spark.createDataFrame(rules, RULES)
    index = rule_index(table, condition_counts(df, table) if counted else None)
    return df, route_by_table(df, index)


def test_rules_equal_brute_force(spark):
    rnd = random.Random(7)
    pick = lambda: (f"a{rnd.randrange(5)}", f"v{min(rnd.randrange(9), 3)}")  # noqa: E731 - some values are frequent
    records = [(i, dict(pick() for _ in range(rnd.randrange(5))), "x", None, "old") for i in range(300)]
    records += [(i % 7, {"a0": "v3", "a1": None}, None, "r", None) for i in range(300)]  # repeated and hot
    records += [(900, None, None, None, None), (901, {}, None, None, None), (None, {"a1": "v3"}, None, None, None)]
    rules = [(f"r{k}", *pick()) for k in range(500) for _ in range(rnd.randrange(1, 4))]
    rules += [("null value", "a0", None), ("null value", "a1", "v3"), ("null attribute", None, "v3"), (None, "a1", "v3"),
              ("both", "a1", "v1"), ("both", "a1", "v3"), ("twice", "a1", "v3"), ("twice", "a1", "v3"), ("", "a0", "v3")]
    for counted in (True, False):
        _, out = routed(spark, records, rules, counted)
        assert out.columns == ["id", "attributes", "attribute", "rule", "relationship"]
        got = sorted(((r["id"], r["relationship"]) for r in out.collect()), key=repr)
        assert got == brute(records, rules) and any(r == "twice" for _, r in got)
        assert not {"null value", "null attribute", "both", None} & {r for _, r in got}


def test_carried_columns_and_unmatched(spark):
    records = [(1, {"k": "a"}, "own", "mine", "old"), (2, {"k": "b"}, None, None, None), (None, {"k": "b"}, None, None, None)]
    df, out = routed(spark, records, [("only a", "k", "a")], True)
    assert [tuple(r)[0:1] + tuple(r)[2:] for r in out.collect()] == [(1, "own", "mine", "only a")]
    rest = unmatched_by_table(df, out, ["id"])
    assert sorted((str(r.id), r.relationship) for r in fan_in(out, rest).collect()) == [
        ("1", "only a"), ("2", "unmatched"), ("None", "unmatched")]


def test_no_rules_and_no_records(spark):
    df, out = routed(spark, [(1, {"k": "a"}, None, None, None)], [], True)
    assert out.count() == 0 and unmatched_by_table(df, out, ["id"]).count() == 1
    assert routed(spark, [], [("r", "k", "a")], True)[1].count() == 0


def test_rarest_condition_files_the_rule_and_the_plan_does_not_grow(spark):
    df = spark.createDataFrame([(i, {"kind": "click", "user": str(i)}, None, None, None) for i in range(50)], RECORDS)
    rules = spark.createDataFrame([("r", "kind", "click"), ("r", "user", "7")], RULES)
    index = rule_index(rules, condition_counts(df, rules))
    assert [(r.attribute, r.value) for r in index.collect()] == [("user", "7")]
    many = spark.createDataFrame([(f"r{k}", "user", str(k)) for k in range(500)], RULES)
    paths = [work_dir(spark, "rule_index") for _ in range(2)]
    rule_index(rules).write.parquet(paths[0])
    rule_index(many).write.parquet(paths[1])
    plans = [route_by_table(df, spark.read.parquet(p))._jdf.queryExecution().analyzed().toString() for p in paths]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines())
    assert "CASE" not in plans[1]


def test_intake_once_on_a_batch(spark):
    schema = "record_id string, created_at timestamp, attributes map<string,string>, content string, size long"
    t = "timestamp'2024-01-01 00:00:00'"
    df = spark.createDataFrame([("a", None, {}, "x", 1), ("a", None, {}, "y", 1), (None, None, {"k": "v", "l": "w"}, "x", 1),
                                (None, None, {"l": "w", "k": "v"}, "x", 1), (None, None, {"k": "v"}, "x", 1)], schema)
    out = intake_once(df.withColumn("created_at", F.expr(t)), "1 hour").collect()
    assert sorted(str(r.record_id) for r in out) == ["None", "None", "a"] and len(out[0]) == 5


def test_intake_once_on_a_stream_and_without_a_time(spark):
    base = work_dir(spark, "intake_once")
    for _ in range(2):
        spark.sql("""select 'POST' method, 'http://a/b' url, map('X-Id', id) headers, 'x' body, cast(t as timestamp) received_at
                     from values ('no time', null), ('timed', '2024-01-01 00:00:00') v(id, t)
                  """).coalesce(1).write.mode("append").json(f"{base}/in")
        taken = intake(read_requests(spark, f"{base}/in", stream=True), "/", record_id=F.col("headers")["X-Id"])
        run_to_end(start_file_sink(intake_once(taken, "1 day").select("record_id"), f"{base}/out", f"{base}/cp",
                                   available_now=True))
    out = spark.read.schema("record_id string").parquet(f"{base}/out").collect()
    assert sorted(r.record_id for r in out) == ["no time", "no time", "timed"]  # as the docstring says
