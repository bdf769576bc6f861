from pyspark.sql import functions as F

from flowspark.functions import (append, data_size_bytes, default_if_empty, default_if_null,
                                 duration_ms, header_attributes, is_https, is_missing, is_uuid,
                                 parse_data_size, parse_duration, preview, query_params, redact,
                                 short_type, template, trigger_interval, trim_trailing_slash,
                                 under_base_path)


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_parse_data_size(spark):
    cases = {"1KB": 1024, "10KB": 10240, "1 GB": 1073741824, "5 furlong": None, "7": 7,
             "1.5 KB": 1536, None: None, "9223372036854775807": 9223372036854775807,
             "9223372036854775808": None, "99999999999999999999 TB": None}
    for text, want in cases.items():
        assert one(spark, parse_data_size("x"), text) == want, text
        if text is not None:
            assert data_size_bytes(text) == want, text


def test_parse_duration(spark):
    cases = {"60 sec": 60000, "10 sec": 10000, "0 sec": 0, "30 secs": 30000, "5 minutes": 300000,
             "8 hours": 28800000, "1 day": 86400000, "3 fortnights": None}
    for text, want in cases.items():
        assert one(spark, parse_duration("x"), text) == want, text
        assert duration_ms(text) == want, text
    assert trigger_interval("60 sec") == "60000 milliseconds"


def test_scalar_cases(spark):
    assert one(spark, short_type("x"), "org.example.stages.standard.LogLines") == "LogLines"
    assert one(spark, trim_trailing_slash("x"), "https://h:8443/") == "https://h:8443"
    assert one(spark, trim_trailing_slash("x"), "https://h:8443//") == "https://h:8443"
    assert one(spark, is_uuid("x"), "a1b2c3d4-0000-0000-0000-000000000000") is True
    assert one(spark, is_uuid("x"), "e5f6g7h8-1111-1111-1111-111111111111") is False
    assert one(spark, is_uuid("x"), None) is False
    assert one(spark, is_https("x"), "http://a") is False
    assert one(spark, is_https("x"), "https://a") is True
    assert one(spark, preview("x", 5), "abcdefgh") == "abcde"


def test_missing_and_defaults(spark):
    for v, want in [(None, True), ("", True), ("null", True), ("id-1", False)]:
        assert one(spark, is_missing("x"), v) is want
    assert one(spark, default_if_empty("x", "d"), "") == "d"
    assert one(spark, default_if_empty("x", "d"), None) == "d"
    assert one(spark, default_if_null("x", "d"), "") == ""
    assert one(spark, default_if_null("x", "d"), None) == "d"


def test_append_and_template_treat_missing_as_empty(spark):
    assert one(spark, append("x", ".large"), None) == ".large"
    assert one(spark, append("x", ".large"), "f1") == "f1.large"
    assert one(spark, template("/out/", F.col("x"), "/y"), None) == "/out//y"
    assert one(spark, template("/out/", F.col("x")), "large") == "/out/large"


def test_query_params_first_value_wins(spark):
    m = one(spark, query_params("x", prefix=""), "http://h/p?a=1&a=2&b=3&c&d=x=y#frag")
    assert m == {"a": "1", "b": "3", "c": "", "d": "x=y"}
    m = one(spark, query_params("x"), "http://localhost:9999/data?size=large")
    assert m == {"http.query.param.size": "large"}
    assert one(spark, query_params("x"), "http://h/p") == {}
    assert one(spark, query_params("x", prefix=""), "http://h/p?q=a%20b") == {"q": "a b"}


def test_base_path(spark):
    df = spark.createDataFrame([("http://h:9999/data?size=large",), ("http://h:9999/data/x",),
                                ("http://h:9999/database",), ("http://h:9999/other?size=small",)], "u string")
    got = [r[0] for r in df.select(under_base_path("u", "data")).collect()]
    assert got == [True, True, False, False]


def test_header_regex_full_match(spark):
    df = spark.createDataFrame([({"X-A": "1", "x-b": "2", "Content-Type": "t"},)], "h map<string,string>")
    assert df.select(header_attributes("h", "X-.*")).first()[0] == {"X-A": "1"}
    assert df.select(header_attributes("h", ".*")).first()[0] == {"X-A": "1", "x-b": "2", "Content-Type": "t"}


def test_redact(spark):
    text = 'Authorization: Bearer abc.DEF-123 and token = "deadbeef" mail joe.19@mail5.example.com ok'
    out = one(spark, redact("x"), text)
    assert "abc.DEF-123" not in out and "deadbeef" not in out and "joe.19@" not in out
    assert "Bearer ***" in out and "token = ***" in out and "[email]" in out and out.endswith(" ok")


def test_drop_secret_keys(spark):
    from flowspark.functions import drop_secret_keys
    df = spark.createDataFrame([({"Password": "x", "token": "y", "filename": "f"},)], "a map<string,string>")
    assert df.select(drop_secret_keys("a")).first()[0] == {"filename": "f"}


def test_format_time_ntz_ignores_session_zone(spark):
    import datetime as dt
    from flowspark.functions import format_time
    df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 0, 123456),)], "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # 02:30 falls in its DST gap
        assert df.select(format_time("t", ntz=True)).first()[0] == "2024-03-10 02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_redaction_of_addresses_is_linear_and_unchanged(spark):
    import time

    from flowspark.functions.redact import redact
    rows = [("a@b.com_x@y.com", "[email][email]"), ("x a@b..com y", "x a@b..com y"), ("a@b.c1.com2", "[email]2"),
            ("u" * 60000 + " a@b.com", "u" * 60000 + " [email]"), ("a@" + "b." * 20000 + "com", "[email]"),
            ("@" * 500 + "é@b.com", "@" * 500 + "é@b.com"), ("a@b@c.org", "a@[email]"), ("a@-.x.com", "[email]")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, t string")
    df.select(redact("t")).limit(1).collect()  # compile
    began = time.time()
    got = {r.id: r.r for r in df.select("id", redact("t").alias("r")).collect()}
    assert time.time() - began < 10
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]


def test_any_url_has_path_and_query(spark):
    from flowspark.functions.urls import query_params, url_path
    df = spark.createDataFrame([("/data?size=large&q=a|b",), ("/data?size=large&t={x}",),
                                ("http://h/data?size=large&q=a b#f",), ("mailto:x",), (None,)], "u string")
    got = [(r.p, r.q) for r in df.select(url_path("u").alias("p"), query_params("u", "").alias("q")).collect()]
    assert got == [("/data", {"size": "large", "q": "a|b"}), ("/data", {"size": "large", "t": "{x}"}),
                   ("/data", {"size": "large", "q": "a b"}), ("x", {}), (None, {})]
