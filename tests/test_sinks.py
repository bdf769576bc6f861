import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowspark.operators import compact_store, latest, log_lines, parse_log, read_store, store
from flowspark.session import work_dir

T0 = dt.datetime(2024, 1, 1)


def recs(spark, rows):
    return spark.createDataFrame(rows, "record_id string, created_at timestamp_ntz, "
                                       "attributes map<string,string>, content string")


def test_log_block_golden_text(spark):
    df = recs(spark, [("12345678", T0, {"filename": "12345678"}, "Hello from the flow!")])
    line = log_lines(df, payload=True).first()["line"]
    assert line == ("Logging record 12345678\nRecord attributes\nKey: 'filename'\n"
                    "  Value: '12345678'\nPayload: Hello from the flow!")


def test_log_keys_sorted_and_levels(spark):
    df = recs(spark, [("1", T0, {"b": "2", "a": "1"}, None)])
    out = log_lines(df.withColumn("lv", F.lit("debug")), level=F.col("lv"), min_level="info")
    assert out.count() == 0
    line = log_lines(df, level="warn", min_level="info").first()
    assert line["level"] == "warn" and line["line"].index("'a'") < line["line"].index("'b'")


def test_parse_log_inverts_log_lines(spark):
    payload = "text\nKey: 'fake'\n  Value: 'no'\nPayload: inner"
    rows = [("1", T0, {"filename": "f", "x": "it's"}, payload), ("2", T0, {}, ""),
            ("3", T0, {"multi": "a\nb"}, None)]
    df = recs(spark, rows)
    back = {r.record_id: (r.attributes, r.content) for r in
            parse_log(log_lines(df, payload=True)).collect()}
    assert back["1"] == ({"filename": "f", "x": "it's"}, payload)
    assert back["2"] == ({}, "")
    assert back["3"] == ({"multi": "a\nb"}, "")


def test_latest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([("d", "f", 1, T0, "a"), ("d", "f", 2, T0, "b"),
                                ("d", "g", 3, T0, "c")],
                               "dir string, file string, id int, created_at timestamp_ntz, v string")
    got = {(r.dir, r.file): r.v for r in latest(df, ["dir", "file"], ["created_at", "id"]).collect()}
    assert got == {("d", "f"): "b", ("d", "g"): "c"}


def test_store_replace_is_idempotent_and_rejects_nulls(spark):
    root = work_dir(spark, "test_store")
    rows = [("1", T0, "large", "a.large", "v1"), ("2", T0 + dt.timedelta(seconds=1), "large", "a.large", "v2"),
            ("3", T0, "small", "b.small", "v3"), ("4", T0, None, "c", "v4")]
    df = spark.createDataFrame(rows, "record_id string, created_at timestamp_ntz, category string, "
                                     "filename string, content string")
    rejects = store(df, root, "category", "filename")
    assert [r.record_id for r in rejects.collect()] == ["4"]
    store(df, root, "category", "filename")  # replayed write
    later = spark.createDataFrame([("5", T0 + dt.timedelta(seconds=5), "small", "b.small", "v5")], df.schema)
    store(later, root, "category", "filename")
    got = {(r.category, r.filename): r.content for r in read_store(spark, root, "category", "filename").collect()}
    assert got == {("large", "a.large"): "v2", ("small", "b.small"): "v5"}
    compacted = compact_store(spark, root, root + "_compact", "category", "filename")
    assert {(r.category, r.filename): r.content for r in compacted.collect()} == got


def test_store_rejects_other_strategies(spark):
    df = spark.createDataFrame([("a", "b")], "category string, filename string")
    with pytest.raises(ValueError):
        store(df, "/nowhere", "category", "filename", conflict="ignore")


def test_write_log_then_scan_lines(spark):
    from flowspark.operators import write_log
    from flowspark.sources import read_log
    df = recs(spark, [("1", T0, {"a": "x"}, "p"), ("2", T0, {"a": "y"}, "q")])
    path = work_dir(spark, "test_write_log")
    write_log(log_lines(df, payload=True), path)
    lines = read_log(spark, path)
    assert lines.filter(F.col("value").startswith("Logging record ")).count() == 2
    assert lines.filter(F.col("value").contains("Value: 'y'")).count() == 1


def test_read_store_prunes_directories(spark):
    root = work_dir(spark, "test_store_prune")
    rows = [(str(i), T0, c, f"f{i}", "v") for i, c in enumerate(["large", "small", "large"])]
    df = spark.createDataFrame(rows, "record_id string, created_at timestamp_ntz, category string, "
                                     "filename string, content string")
    store(df, root, "category", "filename")
    got = read_store(spark, root, "category", "filename", directories=["small"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(category" in plan and "small" in plan
    assert [r.record_id for r in got.collect()] == ["1"]


def test_typed_log_lines_equal_map_path(spark):
    df = spark.createDataFrame([("1", "a", None, "p"), ("2", "b", "x", None)],
                               "record_id string, t string, u string, content string")
    typed = log_lines(df, payload=True, columns={"t": F.col("t"), "u": F.col("u")})
    recs = df.withColumn("attributes", F.map_filter(F.create_map(F.lit("t"), F.col("t"), F.lit("u"), F.col("u")),
                                                    lambda k, v: v.isNotNull()))
    mapped = log_lines(recs, payload=True)
    assert sorted(typed.collect()) == sorted(mapped.collect())


def test_log_texts_cannot_forge_lines(spark):
    rows = [("Logging record 9", T0, {"a": "x\nPayload: evil", "b": "x'\nKey: 'a'\n  Value: 'no", "c\nd": "\\n\r"},
             "p\nLogging record 7\nRecord attributes"), ("2", T0, {"e": "\\"}, "\\\n\\"), ("\\^3", T0, {}, "")]
    df = recs(spark, rows)
    from flowspark.operators import write_log
    from flowspark.sources import read_log_blocks
    path = work_dir(spark, "test_log_blocks")
    write_log(log_lines(df, payload=True), path)
    want = {r[0]: (r[2], r[3]) for r in rows}
    for lines in (log_lines(df, payload=True), read_log_blocks(spark, path)):
        assert {r.record_id: (r.attributes, r.content) for r in parse_log(lines).collect()} == want


def test_repeated_keys_in_a_block_keep_the_first(spark):
    line = "Logging record 1\nRecord attributes\nKey: 'a'\n  Value: '1'\nKey: 'a'\n  Value: '2'"
    assert parse_log(spark.createDataFrame([(line,)], "line string")).first().attributes == {"a": "1"}


def test_other_layouts_are_parameters(spark):
    from flowspark.operators import LogLayout
    # A documented log text and its markers.
    layout = LogLayout(head="LogAttribute: logging for flow file...", section="Standard FlowFile Attributes",
                       payload="FlowFile Payload: ")
    text = ("LogAttribute: logging for flow file...\nStandard FlowFile Attributes\nKey: 'filename'\n"
            "  Value: '12345678'\nFlowFile Payload: Hello!")
    got = parse_log(spark.createDataFrame([(text,)], "line string"), layout=layout).first()
    assert (got.record_id, got.attributes, got.content) == (None, {"filename": "12345678"}, "Hello!")
    df = recs(spark, [("1", T0, {"filename": "12345678"}, "Hello!")])
    assert log_lines(df, payload=True, layout=layout).first()["line"] == text


def test_store_keeps_folder_names_as_written(spark):
    root = work_dir(spark, "test_store_names")
    rows = [(str(i), T0, d, "f") for i, d in enumerate(["01", "1", "", "007"])]
    df = spark.createDataFrame(rows, "record_id string, created_at timestamp_ntz, category string, filename string")
    assert [r.record_id for r in store(df, root, "category", "filename").collect()] == ["2"]
    got = read_store(spark, root, "category", "filename")
    assert dict(got.dtypes)["category"] == "string"
    assert {r.category for r in got.collect()} == {"01", "1", "007"}
    compacted = compact_store(spark, root, root + "_compact", "category", "filename")
    assert {r.category for r in compacted.collect()} == {"01", "1", "007"}


def test_null_attribute_values_are_absent_on_both_log_paths(spark):
    df = spark.createDataFrame([("1", "a", None), ("2", None, None)], "record_id string, t string, u string")
    mapped = df.withColumn("attributes", F.create_map(F.lit("t"), F.col("t"), F.lit("u"), F.col("u")))
    typed = log_lines(df, columns={"t": F.col("t"), "u": F.col("u")})
    assert sorted(log_lines(mapped).collect()) == sorted(typed.collect())
    assert {r.record_id: r.attributes for r in parse_log(log_lines(mapped)).collect()} == {"1": {"t": "a"}, "2": {}}


def test_parse_log_extracts_pairs_twice_at_most_and_is_linear(spark):
    import time
    took = []
    for n in (500, 5000):
        df = recs(spark, [("1", T0, {f"key{k}": f"value {k}\\ \n" for k in range(n)}, "p")])
        out = parse_log(log_lines(df, payload=True))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") <= 2
        out.collect()
        began = time.time()
        assert len(out.first().attributes) == n
        took.append(time.time() - began)
    assert took[1] < 40 * took[0] + 1  # ten times the keys; quadratic would be a hundred times
