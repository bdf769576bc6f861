"""Registered queries: each reads the given tables and has, where SQL can say
it, the equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions import (append, data_size_bytes, default_if_empty, equals,
                                 header_attributes, is_https, is_missing, is_uuid, parse_data_size,
                                 parse_duration, preview, redact, trim_trailing_slash)
from flowspark.functions.redact import drop_secret_keys
from flowspark.operators import (GenerationStore, classify, condition_counts, contains, drop_rel, error_rate_spike, expire,
                                 expiry_warning, fan_in, fan_out, index_log, latest, listing_text, log_lines,
                                 lookup, older_than, parse_log, prioritize, project_listing,
                                 queue_pressure, read_store, route, route_by_table, route_update, rule_index, running_totals,
                                 scan_listing, search_log,
                                 select_rel, status_positions, status_summary, store, tail,
                                 threshold_alert, transition, unmatched, unmatched_by_table, update,
                                 update_attributes, write_log)
from flowspark.operators.report import ITEM_SCHEMA
from flowspark.plans.flow import Flow
from flowspark.plans.presets import route_and_store_flow, route_and_update, sample_flow
from flowspark.records import attr, to_records
from flowspark.session import work_dir
from flowspark.sources import generate_records, intake, intake_once, read_log_blocks, read_requests
from flowspark.streaming import (beat, error_counts_stream, error_spike_stream, latest_depth, latest_snapshot,
                                 queue_depth_stream, run_to_end, sliding_counts, start_batches, start_file_sink,
                                 start_snapshot_sink, store_stream, stream_table, trailing_counts)
from flowspark.streaming.shared import start_shared, store_of
from flowspark.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return wrap


# ---------------------------------------------------------------- flagship
def _flagship_rules() -> dict:
    """``size`` = large / small on the events stand-in: purchase → large, click → small."""
    return {"large": F.col("event_type") == "purchase", "small": F.col("event_type") == "click"}


def _flagship_columns(out: DataFrame) -> DataFrame:
    return out.select(F.col("event_id").alias("record_id"), F.col("ts").alias("created_at"),
                      "user_id", "category", "processing_time", "filename", "directory",
                      F.octet_length("props").cast("bigint").alias("size"))


@register("route_and_store", sql="""
SELECT event_id AS record_id, ts AS created_at, user_id,
       CASE event_type WHEN 'purchase' THEN 'large' ELSE 'small' END AS category,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS processing_time,
       CAST(event_id AS VARCHAR) || '.' || CASE event_type WHEN 'purchase' THEN 'large' ELSE 'small' END AS filename,
       'output/' || CASE event_type WHEN 'purchase' THEN 'large' ELSE 'small' END AS directory,
       CAST(strlen(props) AS BIGINT) AS size
FROM events WHERE event_type IN ('purchase', 'click')
""")
def route_and_store(spark: SparkSession, root: str) -> DataFrame:
    """Flagship: route purchase → large, click → small; update category, time, filename, folder."""
    ev = table(spark, root, "events")
    rules = _flagship_rules()
    out = route_and_update(ev, rules, filename=F.col("event_id").cast("string"), now=F.col("ts"))
    return _flagship_columns(out)


# ---------------------------------------------------------------- routing
@register("route_multi_match", sql="""
SELECT event_id, 'very_high' AS relationship, value FROM events WHERE value > 50
UNION ALL
SELECT event_id, 'purchase' AS relationship, value FROM events WHERE event_type = 'purchase'
""")
def route_multi_match(spark: SparkSession, root: str) -> DataFrame:
    """One row per true rule; the connection takes two of three relationships."""
    ev = table(spark, root, "events")
    routed = route(ev, {"high": F.col("value") > 10, "very_high": F.col("value") > 50,
                        "purchase": F.col("event_type") == "purchase"})
    return select_rel(routed, "very_high", "purchase").select("event_id", "relationship", "value")


@register("route_unmatched", sql="""
SELECT event_id, event_type, 'unmatched' AS relationship FROM events
WHERE NOT coalesce(event_type IN ('purchase', 'click'), false)
""")
def route_unmatched(spark: SparkSession, root: str) -> DataFrame:
    """Rows no rule matches, labelled unmatched (a filter, pushed to the scan)."""
    ev = table(spark, root, "events")
    return unmatched(ev, _flagship_rules()).select("event_id", "event_type", "relationship")


@register("route_auto_terminate", sql="""
SELECT event_id, CASE event_type WHEN 'purchase' THEN 'large' ELSE 'unmatched' END AS relationship
FROM events WHERE coalesce(event_type, '') <> 'click'
""")
def route_auto_terminate(spark: SparkSession, root: str) -> DataFrame:
    """One matched relationship is auto-terminated, the other and unmatched go on."""
    ev = table(spark, root, "events")
    return drop_rel(route(ev, _flagship_rules(), keep_unmatched=True), "small").select("event_id", "relationship")


@register("route_by_size", sql="""
SELECT CASE WHEN strlen(text) > 10240 THEN 'large' ELSE 'small' END AS relationship,
       count(*) AS n_records, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes
FROM documents GROUP BY 1
""")
def route_by_size(spark: SparkSession, root: str) -> DataFrame:
    """Documents routed by byte size (10 KB), counted per branch."""
    docs = to_records(table(spark, root, "documents"), "doc_id", F.lit(None).cast("timestamp_ntz"),
                      content="text")
    limit = data_size_bytes("10KB")
    routed = route(docs, {"large": F.col("size") > limit, "small": F.col("size") <= limit})
    return routed.groupBy("relationship").agg(F.count(F.lit(1)).alias("n_records"),
                                              F.sum("size").alias("total_bytes"))


@register("fan_in_union", sql="""
SELECT event_id, 'view' AS branch, 'browse' AS category, CAST(NULL AS BOOLEAN) AS welcome
FROM events WHERE event_type = 'view'
UNION ALL
SELECT event_id, 'signup' AS branch, 'account' AS category, true AS welcome
FROM events WHERE event_type = 'signup'
""")
def fan_in_union(spark: SparkSession, root: str) -> DataFrame:
    """Fan-out into two branches with their own updates, fan-in by name."""
    ev = table(spark, root, "events").select("event_id", "event_type")
    b = fan_out(ev, {"view": F.col("event_type") == "view", "signup": F.col("event_type") == "signup"})
    view = update(b["view"], {"branch": "view", "category": "browse"})
    signup = update(b["signup"], {"branch": "signup", "category": "account", "welcome": F.lit(True)})
    return fan_in(view, signup).select("event_id", "branch", "category", "welcome")


# ---------------------------------------------------------------- attribute map path
def _event_records(spark: SparkSession, root: str) -> DataFrame:
    ev = table(spark, root, "events")
    return to_records(ev, "event_id", "ts", content="props", attributes={
        "event_type": F.col("event_type"), "user_id": F.col("user_id"),
        "filename": F.col("event_id")})


@register("attr_map_update", sql="""
SELECT CAST(event_id AS VARCHAR) AS record_id, event_type AS category,
       CAST(event_id AS VARCHAR) || '.log' AS filename, upper(event_type) AS event_type,
       false AS has_user_id, 3 AS n_attrs
FROM events
""")
def attr_map_update(spark: SparkSession, root: str) -> DataFrame:
    """Attribute-map update: overwrite, add and remove keys in one step."""
    recs = update_attributes(_event_records(spark, root), {
        "category": attr("event_type"),
        "filename": append(attr("filename"), ".log"),
        "event_type": F.upper(attr("event_type")),
        "user_id": F.lit(None)})
    return recs.select("record_id", attr("category").alias("category"),
                       attr("filename").alias("filename"), attr("event_type").alias("event_type"),
                       F.map_contains_key("attributes", "user_id").alias("has_user_id"),
                       F.size("attributes").alias("n_attrs"))


@register("attr_map_route", sql="""
SELECT CAST(event_id AS VARCHAR) AS record_id, 'hot' AS relationship,
       json_extract_string(props, '$.k') AS k FROM events
WHERE TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) >= 90
UNION ALL
SELECT CAST(event_id AS VARCHAR), 'error', json_extract_string(props, '$.k') FROM events
WHERE event_type = 'error'
""")
def attr_map_route(spark: SparkSession, root: str) -> DataFrame:
    """Route on map attributes parsed from JSON properties."""
    ev = table(spark, root, "events")
    recs = update_attributes(
        ev.select(F.col("event_id").cast("string").alias("record_id"), "event_type",
                  F.from_json("props", "map<string,string>").alias("attributes")),
        {"event_type": F.col("event_type")})
    routed = route(recs, {"hot": attr("k").try_cast("int") >= 90,
                          "error": equals(attr("event_type"), "error")})
    return routed.select("record_id", "relationship", attr("k").alias("k"))


# ---------------------------------------------------------------- requests
def _page_requests(spark: SparkSession, root: str, base_path: str) -> DataFrame:
    pages = table(spark, root, "pages").select(
        "page_id", "url", F.col("html").alias("body"),
        F.lit(None).cast("timestamp_ntz").alias("received_at"))
    return intake(pages, base_path=base_path, headers=None, methods=None, record_id="page_id")


_PARAMS_CTE = r"""
WITH q AS (
  SELECT page_id, url, html, regexp_extract(url, '^[^#?]*\?([^#]*)', 1) AS qs FROM pages
), parts AS (
  SELECT page_id, unnest(string_split(qs, '&')) AS p, unnest(range(1, len(string_split(qs, '&')) + 1)) AS pos
  FROM q
), kv AS (
  SELECT page_id, pos,
         'http.query.param.' || url_decode(CASE WHEN instr(p, '=') > 0 THEN split_part(p, '=', 1) ELSE p END) AS key,
         url_decode(CASE WHEN instr(p, '=') > 0 THEN substr(p, instr(p, '=') + 1) ELSE '' END) AS value
  FROM parts WHERE p <> ''
), firsts AS (
  SELECT page_id, key, value FROM kv
  QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY pos) = 1
)
"""


@register("request_query_params", sql=_PARAMS_CTE + """
SELECT CAST(page_id AS VARCHAR) AS record_id, key, value FROM firsts
""")
def request_query_params(spark: SparkSession, root: str) -> DataFrame:
    """Query parameters of captured requests as attributes (first value wins)."""
    recs = _page_requests(spark, root, "/")
    # explode would add a filter on the map's size, which builds the map once more
    pairs = recs.select("record_id", F.explode_outer("attributes").alias("key", "value"))
    return pairs.filter(F.col("key").isNotNull())


@register("request_route_by_param", sql=_PARAMS_CTE + """
, en AS (
  SELECT page_id, html FROM pages
  WHERE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '/en'
     OR starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/en/')
), routed AS (
  SELECT en.page_id, en.html, 'feed' AS rel FROM en JOIN firsts f
    ON f.page_id = en.page_id AND f.key = 'http.query.param.utm_source' AND f.value = 'feed'
  UNION ALL
  SELECT en.page_id, en.html, 'paged' FROM en JOIN firsts f
    ON f.page_id = en.page_id AND f.key = 'http.query.param.page'
)
SELECT CAST(page_id AS VARCHAR) AS record_id, rel AS category,
       CAST(page_id AS VARCHAR) || '.' || rel AS filename, 'output/' || rel AS directory,
       CAST(strlen(html) AS BIGINT) AS size
FROM routed
""")
def request_route_by_param(spark: SparkSession, root: str) -> DataFrame:
    """Requests under /en routed on query parameters, then updated per branch."""
    recs = _page_requests(spark, root, "en")
    rules = {"feed": equals(attr("http.query.param.utm_source"), "feed"),
             "paged": attr("http.query.param.page").isNotNull()}
    out = route_and_update(recs, rules, filename=F.col("record_id"), now=F.col("created_at"), prefilter=False)
    return out.select("record_id", "category", "filename", "directory", "size")


@register("request_odd_urls", sql="""
SELECT CAST(page_id AS VARCHAR) AS record_id, 'a|b {x}' AS q, 'c d' AS t, CAST(page_id AS VARCHAR) AS n
FROM pages
""")
def request_odd_urls(spark: SparkSession, root: str) -> DataFrame:
    """Requests whose query holds characters that strict parsers refuse: none is lost."""
    pages = table(spark, root, "pages").select(
        "page_id", F.col("html").alias("body"), F.lit(None).cast("timestamp_ntz").alias("received_at"),
        F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?q=a|b {x}&t=c d&n="),
                 F.col("page_id").cast("string")).alias("url"))
    recs = intake(pages, base_path="/", headers=None, methods=None, record_id="page_id")
    return recs.select("record_id", *[attr(f"http.query.param.{k}").alias(k) for k in ("q", "t", "n")])


@register("header_regex_attributes", sql="""
SELECT event_id, CAST(user_id AS VARCHAR) AS x_user_id, event_type AS x_event_type,
       false AS has_content_type, 2 AS n_attrs
FROM events
""")
def header_regex_attributes(spark: SparkSession, root: str) -> DataFrame:
    """Headers whose names fully match X-.* become attributes."""
    ev = table(spark, root, "events")
    headers = F.create_map(F.lit("X-User-Id"), F.col("user_id").cast("string"),
                           F.lit("X-Event-Type"), F.col("event_type"),
                           F.lit("Content-Type"), F.lit("application/json"),
                           F.lit("x-lower"), F.lower("event_type"))
    attrs = header_attributes(headers, "X-.*")
    return ev.select("event_id", attrs["X-User-Id"].alias("x_user_id"),
                     attrs["X-Event-Type"].alias("x_event_type"),
                     F.map_contains_key(attrs, "Content-Type").alias("has_content_type"),
                     F.size(attrs).alias("n_attrs"))


# ---------------------------------------------------------------- checks
@register("https_only", sql="""
SELECT page_id, url, regexp_replace(url, '/+$', '') AS base_url FROM pages
WHERE starts_with(url, 'https://')
""")
def https_only(spark: SparkSession, root: str) -> DataFrame:
    """Pages served over HTTPS, with the base URL's trailing slashes trimmed."""
    pages = table(spark, root, "pages")
    return pages.filter(is_https("url")).select("page_id", "url",
                                                trim_trailing_slash("url").alias("base_url"))


@register("uuid_check", sql="""
WITH x AS (
  SELECT event_id, value, md5(CAST(event_id AS VARCHAR)) AS m FROM events
), y AS (
  SELECT event_id, value, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4)
         || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS h FROM x
), z AS (
  SELECT event_id, CASE WHEN value > 50 THEN translate(h, 'a', 'g') ELSE h END AS candidate FROM y
)
SELECT event_id, candidate,
       regexp_full_match(candidate, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') AS is_uuid
FROM z
""")
def uuid_check(spark: SparkSession, root: str) -> DataFrame:
    """Canonical UUID check on ids made from the events."""
    ev = table(spark, root, "events")
    m = F.md5(F.col("event_id").cast("string"))
    h = F.concat_ws("-", F.substr(m, F.lit(1), F.lit(8)), F.substr(m, F.lit(9), F.lit(4)),
                    F.substr(m, F.lit(13), F.lit(4)), F.substr(m, F.lit(17), F.lit(4)),
                    F.substr(m, F.lit(21), F.lit(12)))
    cand = F.when(F.col("value") > 50, F.translate(h, "a", "g")).otherwise(h)
    return ev.select("event_id", cand.alias("candidate")).withColumn("is_uuid", is_uuid("candidate"))


# ---------------------------------------------------------------- generator
@register("generate_records", sql="""
WITH r AS (
  SELECT CAST(o_orderkey AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS record_id, o_orderdate AS created_at
  FROM orders, range(2) t(i)
)
SELECT record_id, created_at, CAST(1024 AS BIGINT) AS size,
       md5(left(repeat(sha256(record_id), 16), 1024)) AS content_md5,
       record_id AS filename
FROM r
""")
def generate_records_q(spark: SparkSession, root: str) -> DataFrame:
    """Two 1 KB records per firing (one firing per order)."""
    firings = table(spark, root, "orders")
    recs = generate_records(firings, "o_orderkey", "o_orderdate", batch_size=2, file_size="1KB")
    return recs.select("record_id", "created_at", "size", F.md5("content").alias("content_md5"),
                       attr("filename").alias("filename"))


@register("generate_custom_text", sql="""
SELECT CAST(o_orderkey AS VARCHAR) || '-0' AS record_id, o_orderdate AS created_at,
       'Hello from the flow!' AS content, CAST(20 AS BIGINT) AS size
FROM orders
""")
def generate_custom_text(spark: SparkSession, root: str) -> DataFrame:
    """One custom-text record per firing; the text wins over the size."""
    firings = table(spark, root, "orders")
    recs = generate_records(firings, "o_orderkey", "o_orderdate", batch_size=1, file_size="1KB",
                            custom_text="Hello from the flow!")
    return recs.select("record_id", "created_at", "content", "size")


# ---------------------------------------------------------------- logging
_LOG_SQL = """
'Logging record ' || CAST(event_id AS VARCHAR) || chr(10) || 'Record attributes' || chr(10)
|| 'Key: ''event_type''' || chr(10) || '  Value: ''' || event_type || '''' || chr(10)
|| 'Key: ''filename''' || chr(10) || '  Value: ''' || CAST(event_id AS VARCHAR) || '''' || chr(10)
|| 'Key: ''user_id''' || chr(10) || '  Value: ''' || CAST(user_id AS VARCHAR) || ''''
"""


@register("log_lines", sql=f"""
SELECT CAST(event_id AS VARCHAR) AS record_id,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'debug' ELSE 'info' END AS level,
       {_LOG_SQL} || chr(10) || 'Payload: ' || props AS line
FROM events WHERE event_type <> 'click'
""")
def log_lines_q(spark: SparkSession, root: str) -> DataFrame:
    """Attribute log blocks with payload; debug blocks dropped by the level filter."""
    recs = _event_records(spark, root).withColumn("level", _event_level_from_attrs())
    return log_lines(recs, level=F.col("level"), payload=True, min_level="info")


def _event_level_from_attrs() -> F.Column:
    t = attr("event_type")
    return F.when(t == "error", "error").when(t == "click", "debug").otherwise("info")


@register("log_lines_typed", sql=ORACLE["log_lines"])
def log_lines_typed(spark: SparkSession, root: str) -> DataFrame:
    """The same log from typed columns (no attribute map): static text, codegen."""
    ev = table(spark, root, "events")
    level = (F.when(F.col("event_type") == "error", "error")
             .when(F.col("event_type") == "click", "debug").otherwise("info"))
    recs = ev.select(F.col("event_id").cast("string").alias("record_id"), "event_type", "user_id",
                     F.col("props").alias("content"), level.alias("level"))
    return log_lines(recs, level=F.col("level"), payload=True, min_level="info", columns={
        "event_type": F.col("event_type"), "user_id": F.col("user_id"),
        "filename": F.col("record_id")})


@register("log_parse", sql="""
SELECT CAST(event_id AS VARCHAR) AS record_id, event_type, CAST(user_id AS VARCHAR) AS user_id,
       CAST(event_id AS VARCHAR) AS filename, props AS payload, 3 AS n_attrs
FROM events
""")
def log_parse_q(spark: SparkSession, root: str) -> DataFrame:
    """Log blocks parsed back to record id, attributes and payload."""
    parsed = parse_log(log_lines(_event_records(spark, root), payload=True))
    return parsed.select("record_id", attr("event_type").alias("event_type"),
                         attr("user_id").alias("user_id"), attr("filename").alias("filename"),
                         F.col("content").alias("payload"), F.size("attributes").alias("n_attrs"))


@register("log_contains", sql=f"""
SELECT CAST(event_id AS VARCHAR) AS record_id, {_LOG_SQL} AS line
FROM events WHERE event_type = 'error'
""")
def log_contains(spark: SparkSession, root: str) -> DataFrame:
    """Log blocks that contain a given text."""
    lines = log_lines(_event_records(spark, root))
    return contains(lines, "line", "Value: 'error'").select("record_id", "line")


@register("log_tail", sql=f"""
SELECT CAST(event_id AS VARCHAR) AS record_id, ts AS created_at, {_LOG_SQL} AS line
FROM events ORDER BY ts DESC, event_id DESC LIMIT 20
""")
def log_tail(spark: SparkSession, root: str) -> DataFrame:
    """The last 20 log blocks by time (a top-k, no full sort)."""
    recs = _event_records(spark, root).withColumn("event_id", F.col("record_id").cast("bigint"))
    lines = log_lines(recs, keep=["created_at", "event_id"])
    return tail(lines, 20, "created_at", "event_id").select("record_id", "created_at", "line")


@register("redact_secrets", sql=r"""
WITH r AS (
  SELECT doc_id, text,
    regexp_replace(
      regexp_replace(
        regexp_replace(text, '(?i)(bearer\s+)[A-Za-z0-9._~+/=-]+', '\1***', 'g'),
        '(?i)(password|passwd|pwd|secret|token|api[_-]?key)(\s*[:=]\s*)[^\s,;]+', '\1\2***', 'g'),
      '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}', '[email]', 'g') AS redacted
  FROM documents
)
SELECT doc_id, redacted, redacted <> text AS was_redacted FROM r
""")
def redact_secrets(spark: SparkSession, root: str) -> DataFrame:
    """Whole documents with bearer tokens, secrets and e-mail addresses redacted."""
    docs = table(spark, root, "documents")
    return (docs.select("doc_id", "text", redact("text").alias("redacted"))
            .select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("was_redacted")))


# ---------------------------------------------------------------- store (latest wins)
@register("store_replace", sql="""
SELECT event_type AS directory, 'user_' || CAST(user_id AS VARCHAR) AS filename,
       arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS created_at,
       arg_max(value, (ts, event_id)) AS value
FROM events GROUP BY 1, 2
""")
def store_replace(spark: SparkSession, root: str) -> DataFrame:
    """Latest-wins per (directory, filename), the replace rule of the store."""
    ev = table(spark, root, "events").select(
        F.col("event_type").alias("directory"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("filename"),
        "event_id", F.col("ts").alias("created_at"), "value")
    return latest(ev, ["directory", "filename"], ["created_at", "event_id"])


# ---------------------------------------------------------------- listing and lookups
def _listing_bodies(spark: SparkSession, root: str) -> DataFrame:
    conv = table(spark, root, "conversations")
    item = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.struct(F.col("turn").alias("version")).alias("revision"),
        F.struct(F.col("role").alias("name"),
                 F.concat(F.lit("org.example.stage."), F.initcap("role")).alias("type"),
                 F.when(F.col("role") == "assistant", "RUNNING").otherwise("STOPPED").alias("state"))
        .alias("component"))
    # One listing a conversation: its other turns as one array (bounded by the conversation).
    items = F.sort_array(F.collect_list(F.when(F.col("role") != "system", F.struct(
        F.col("turn"), item.alias("item"), preview("text").alias("preview")))))
    packed = conv.groupBy("conv_id").agg(items.alias("turns"))
    return packed.select(
        F.to_json(F.struct(F.transform("turns", lambda t: t["item"]).alias("processors"))).alias("body"),
        F.map_from_entries(F.transform("turns", lambda t: F.struct(
            t["item"]["id"].alias("key"), t["preview"].alias("value")))).alias("previews"))


@register("listing_explode", sql="""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, role AS name,
       'org.example.stage.' || upper(left(role, 1)) || lower(substr(role, 2)) AS type,
       upper(left(role, 1)) || lower(substr(role, 2)) AS short_type,
       CASE WHEN role = 'assistant' THEN 'RUNNING' ELSE 'STOPPED' END AS state,
       turn AS version, left(text, 50) AS preview,
       'ID: ' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || chr(10) || 'Name: ' || role
         || chr(10) || 'Type: org.example.stage.' || upper(left(role, 1)) || lower(substr(role, 2))
         || chr(10) || 'State: ' || CASE WHEN role = 'assistant' THEN 'RUNNING' ELSE 'STOPPED' END AS listing_row
FROM conversations WHERE role <> 'system'
""")
def listing_explode(spark: SparkSession, root: str) -> DataFrame:
    """JSON listings scanned, exploded and projected (id, name, type, state)."""
    items = project_listing(scan_listing(_listing_bodies(spark, root), "body", keep=["previews"]),
                            keep=["previews"])
    items = items.withColumn("preview", F.col("previews")[F.col("id")]).drop("previews")
    return items.withColumn("listing_row", listing_text(F.col("id"), F.col("name"), F.col("type"),
                                                        F.col("state")))


@register("lookup_names", sql="""
SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def lookup_names(spark: SparkSession, root: str) -> DataFrame:
    """Bulk id → name lookup as one left join."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    return lookup(orders, table(spark, root, "customer"), "o_custkey", "c_custkey",
                  ["c_name"]).select("o_orderkey", "c_name")


# ---------------------------------------------------------------- run summaries
def _order_states(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderstatus")
    state = (F.when(F.col("o_orderstatus") == "O", "RUNNING")
             .when(F.col("o_orderstatus") == "F", "STOPPED").otherwise("INVALID"))
    return orders.withColumn("state", state)


_OUTCOME_SQL = """
CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'already_running'
     ELSE 'started' END
"""


@register("status_summary", sql=f"""
SELECT count(*) FILTER (WHERE {_OUTCOME_SQL} = 'started') AS n_started,
       count(*) FILTER (WHERE {_OUTCOME_SQL} = 'already_running') AS n_already_running,
       count(*) FILTER (WHERE {_OUTCOME_SQL} = 'failed') AS n_failed,
       count(*) AS n_total
FROM orders
""")
def status_summary_q(spark: SparkSession, root: str) -> DataFrame:
    """Start outcome counts (started, already running, failed), zero included."""
    st = transition(_order_states(spark, root), "state", "RUNNING",
                    failed=F.col("o_orderstatus") == "P")
    return status_summary(st, "outcome", ["started", "already_running", "failed"])


@register("status_lists", sql=f"""
SELECT {_OUTCOME_SQL} AS outcome, o_orderkey,
       row_number() OVER (PARTITION BY {_OUTCOME_SQL} ORDER BY o_orderkey) AS position
FROM orders
""")
def status_lists(spark: SparkSession, root: str) -> DataFrame:
    """Ids per outcome in long form with their position (skew-safe)."""
    st = transition(_order_states(spark, root), "state", "RUNNING",
                    failed=F.col("o_orderstatus") == "P")
    return status_positions(st, "outcome", "o_orderkey")


@register("transition_report", sql="""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' ELSE 'STOPPED' END AS state,
       CASE o_orderstatus WHEN 'O' THEN 'already_running' ELSE 'started' END AS on_start,
       CASE o_orderstatus WHEN 'O' THEN 'stopped' ELSE 'already_stopped' END AS on_stop
FROM orders WHERE o_orderstatus IN ('O', 'F')
""")
def transition_report(spark: SparkSession, root: str) -> DataFrame:
    """Start and stop outcomes of running / stopped items."""
    st = _order_states(spark, root).filter(F.col("state").isin("RUNNING", "STOPPED"))
    return st.select("o_orderkey", "state",
                     classify(F.col("state"), "RUNNING").alias("on_start"),
                     classify(F.col("state"), "STOPPED").alias("on_stop"))


# ---------------------------------------------------------------- parsers
@register("parse_size_duration", sql="""
WITH t AS (
  SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_brand, p_size % 6 AS u,
         CAST(p_size AS VARCHAR) || CASE p_size % 6 WHEN 0 THEN 'KB' WHEN 1 THEN ' GB' WHEN 2 THEN ' sec'
           WHEN 3 THEN 'furlong' WHEN 4 THEN '' ELSE ' min' END AS text
  FROM part
)
SELECT p_partkey, text,
       CAST(CASE u WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 1073741824 WHEN 4 THEN p_size END AS BIGINT) AS size_bytes,
       CAST(CASE u WHEN 2 THEN p_size * 1000 WHEN 5 THEN p_size * 60000 END AS BIGINT) AS duration_ms,
       CASE WHEN u = 4 THEN 'unbranded' ELSE p_brand END AS label
FROM t
""")
def parse_size_duration(spark: SparkSession, root: str) -> DataFrame:
    """Size and duration texts parsed; empty labels take a default."""
    part = table(spark, root, "part")
    u = F.col("p_size") % 6
    unit = (F.when(u == 0, "KB").when(u == 1, " GB").when(u == 2, " sec").when(u == 3, "furlong")
            .when(u == 4, "").otherwise(" min"))
    t = part.select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("text"),
                    F.when(u == 4, F.lit("")).otherwise(F.col("p_brand")).alias("brand"))
    return t.select("p_partkey", "text", parse_data_size("text").alias("size_bytes"),
                    parse_duration("text").alias("duration_ms"),
                    default_if_empty("brand", "unbranded").alias("label"))


# ---------------------------------------------------------------- queues
@register("expire_records", sql="""
SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'
""")
def expire_records(spark: SparkSession, root: str) -> DataFrame:
    """Records within a 7-day time-to-live at a fixed now."""
    ev = table(spark, root, "events").select("event_id", "ts")
    return expire(ev, "7 days", ts="ts", now="2024-01-31 00:00:00")


@register("queue_pressure", sql="""
WITH w AS (
  SELECT event_id, event_type AS queue,
         count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total_objects,
         CAST(sum(strlen(props)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_bytes
  FROM events
)
SELECT *, total_objects >= 1000 OR total_bytes >= 20480 AS limit_reached FROM w
""")
def queue_pressure_q(spark: SparkSession, root: str) -> DataFrame:
    """Arrivals per queue so far (objects, bytes) and whether a limit is reached."""
    ev = table(spark, root, "events").select(
        "event_id", F.col("event_type").alias("queue"), "ts",
        F.octet_length("props").cast("bigint").alias("size"))
    out = queue_pressure(ev, "queue", ["ts", "event_id"], "size", max_objects=1000,
                         max_bytes="20 KB")
    return out.select("event_id", "queue", "total_objects", "total_bytes", "limit_reached")


@register("prioritize_top", sql="""
SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20
""")
def prioritize_top(spark: SparkSession, root: str) -> DataFrame:
    """The 20 highest-priority records (a top-k)."""
    ev = table(spark, root, "events").select("event_id", "value")
    return prioritize(ev, F.col("value").desc(), F.col("event_id").asc()).limit(20)


# ---------------------------------------------------------------- alerts
@register("alert_threshold", sql="""
SELECT * FROM (
  SELECT event_id, event_type, ts,
         count(*) OVER (PARTITION BY event_type ORDER BY ts
                        RANGE BETWEEN INTERVAL 30 MINUTES PRECEDING AND CURRENT ROW) AS n_recent
  FROM events
) WHERE n_recent > 2
""")
def alert_threshold(spark: SparkSession, root: str) -> DataFrame:
    """Rows with more than 2 same-type events in the trailing 30 minutes."""
    ev = table(spark, root, "events").select("event_id", "event_type", "ts")
    return threshold_alert(ev, "event_type", "ts", "30 minutes", more_than=2)


@register("error_rate_spike", sql="""
WITH per AS (
  SELECT date_trunc('hour', ts) AS period_start, count(*) AS n_events,
         count(*) FILTER (WHERE event_type = 'error') AS n_errors
  FROM events GROUP BY 1
), prior AS (
  SELECT p.period_start, CAST(sum(q.n_events) AS BIGINT) AS pe, CAST(sum(q.n_errors) AS BIGINT) AS perr
  FROM per p JOIN per q
    ON q.period_start >= p.period_start - INTERVAL 3 HOUR AND q.period_start < p.period_start
  GROUP BY 1
)
SELECT p.period_start, n_events, n_errors, coalesce(pe, 0) AS prior_events,
       coalesce(perr, 0) AS prior_errors, round(n_errors / n_events, 6) AS error_rate,
       round(perr / pe, 6) AS trailing_rate,
       coalesce(n_errors / n_events > perr / pe + 0.05, false) AS is_spike
FROM per p LEFT JOIN prior USING (period_start)
""")
def error_rate_spike_q(spark: SparkSession, root: str) -> DataFrame:
    """Hourly error rates against the pooled rate of the 3 hours before."""
    ev = table(spark, root, "events").select("ts", "event_type")
    return error_rate_spike(ev, "ts", F.col("event_type") == "error", period="1 hour",
                            lookback=3, limit=0.05)


@register("expiry_warning", sql="""
SELECT o_orderkey, o_orderdate,
       datediff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) AS days_left
FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-06-01 00:00:00' AND o_orderdate <= TIMESTAMP '1998-07-01 00:00:00'
""")
def expiry_warning_q(spark: SparkSession, root: str) -> DataFrame:
    """Orders dated within 30 days of a fixed now, with days left."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderdate")
    return expiry_warning(orders, "o_orderdate", "30 days", now="1998-06-01 00:00:00")


# ---------------------------------------------------------------- flows
@register("flow_preset_sample", sql=f"""
SELECT CAST(o_orderkey AS VARCHAR) || '-0' AS record_id, 'info' AS level,
       'Logging record ' || CAST(o_orderkey AS VARCHAR) || '-0' || chr(10) || 'Record attributes' || chr(10)
       || 'Key: ''filename''' || chr(10) || '  Value: ''' || CAST(o_orderkey AS VARCHAR) || '-0''' || chr(10)
       || 'Payload: Hello from the flow!' AS line
FROM orders
""")
def flow_preset_sample(spark: SparkSession, root: str) -> DataFrame:
    """The sample flow (generator → log) planned as a batch."""
    flow = sample_flow(table(spark, root, "orders"), "o_orderkey", "o_orderdate",
                       custom_text="Hello from the flow!")
    return flow.plan(spark)["log"]


def _run_and_read(spark: SparkSession, flow: Flow, path: str) -> DataFrame:
    """Run a flow that ends in the stage ``store`` and read the store back."""
    flow.run(spark)
    return _flagship_columns(read_store(spark, path, "category", "filename", order=["ts", "event_id"]))


@register("flow_route_store_graph", sql=ORACLE["route_and_store"])
def flow_route_store_graph(spark: SparkSession, root: str) -> DataFrame:
    """The flagship as a Flow graph: route, one update stage per branch, store; one
    pass over the events, read back from the store."""
    ev = table(spark, root, "events")
    path = work_dir(spark, "flow_route_store_graph")
    flow = route_and_store_flow(ev, _flagship_rules(), filename=F.col("event_id").cast("string"),
                                now=F.col("ts"), store_path=path, order=("ts", "event_id"))
    return _run_and_read(spark, flow, path)


# ---------------------------------------------------------------- streaming (available-now runs)
def _drain(spark: SparkSession, name: str, df: DataFrame, partition_by=(), fmt="parquet") -> str:
    base = work_dir(spark, name)
    q = start_file_sink(df, f"{base}/out", f"{base}/checkpoint", partition_by=partition_by, fmt=fmt,
                        available_now=True)
    run_to_end(q)
    return f"{base}/out"


def _last_rows(spark: SparkSession, name: str, df: DataFrame, *keys: str) -> DataFrame:
    """Drain a bounded stream in update mode; the last row of each key."""
    base = work_dir(spark, name)
    run_to_end(start_snapshot_sink(df, f"{base}/snapshots", f"{base}/checkpoint", available_now=True))
    return latest_snapshot(spark, f"{base}/snapshots", *keys)


@register("stream_route_store", sql=ORACLE["route_and_store"])
def stream_route_store(spark: SparkSession, root: str) -> DataFrame:
    """The flagship as a stream into a partitioned file sink, read back."""
    ev = stream_table(spark, root, "events")
    rules = _flagship_rules()
    out = route_and_update(ev, rules, filename=F.col("event_id").cast("string"), now=F.col("ts"))
    out = _flagship_columns(out)
    path = _drain(spark, "stream_route_store", out, partition_by=["category"])
    return spark.read.schema(out.schema).parquet(path)


@register("stream_generate", sql=ORACLE["generate_records"])
def stream_generate(spark: SparkSession, root: str) -> DataFrame:
    """The generator driven by a stream of firings, stored and read back."""
    firings = stream_table(spark, root, "orders")
    recs = generate_records(firings, "o_orderkey", "o_orderdate", batch_size=2, file_size="1KB")
    path = _drain(spark, "stream_generate", recs)
    stored = spark.read.schema(recs.schema).parquet(path)
    return stored.select("record_id", "created_at", "size", F.md5("content").alias("content_md5"),
                         attr("filename").alias("filename"))


@register("stream_alert_sliding", sql="""
WITH w AS (
  SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) - k * INTERVAL 10 MINUTE AS window_start
  FROM events, range(3) t(k)
), agg AS (
  SELECT window_start, window_start + INTERVAL 30 MINUTE AS window_end, event_type, count(*) AS n_events
  FROM w GROUP BY ALL
)
SELECT * FROM agg WHERE n_events > 2
""")
def stream_alert_sliding(spark: SparkSession, root: str) -> DataFrame:
    """Sliding 30-minute windows every 10 minutes: counts go out as they change,
    and the last one of each window is read, so open windows are in too."""
    ev = stream_table(spark, root, "events").select("event_type", "ts")
    counts = sliding_counts(ev, "event_type", "ts", "30 minutes", "10 minutes", "30 minutes")
    last = _last_rows(spark, "stream_alert_sliding", counts, "window_start", "window_end", "event_type")
    return last.filter("n_events > 2")


@register("stream_log_tail", sql="""
SELECT CAST(event_id AS VARCHAR) AS record_id, event_type, CAST(user_id AS VARCHAR) AS user_id
FROM events WHERE event_type = 'error'
""")
def stream_log_tail(spark: SparkSession, root: str) -> DataFrame:
    """Write the event log as text, then follow its blocks as a stream and keep matching ones."""
    base = work_dir(spark, "stream_log_tail")
    write_log(log_lines(_event_records(spark, root)), f"{base}/log")
    parsed = parse_log(read_log_blocks(spark, f"{base}/log", stream=True))
    hits = parsed.filter(equals(attr("event_type"), "error")).select(
        "record_id", attr("event_type").alias("event_type"), attr("user_id").alias("user_id"))
    q = start_file_sink(hits, f"{base}/out", f"{base}/checkpoint", available_now=True)
    run_to_end(q)
    return spark.read.schema(hits.schema).parquet(f"{base}/out")


@register("log_file_round_trip", sql="""
SELECT CAST(doc_id AS VARCHAR) AS record_id, text AS note, lang, text AS payload FROM documents
""")
def log_file_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Whole documents, line ends and all, as attribute and payload: written as log
    text, read back as blocks and parsed."""
    path = work_dir(spark, "log_file_round_trip")
    docs = table(spark, root, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"), "text", "lang", F.col("text").alias("content"))
    write_log(log_lines(docs, payload=True, columns={"note": F.col("text"), "lang": F.col("lang")}), path)
    parsed = parse_log(read_log_blocks(spark, path))
    return parsed.select("record_id", attr("note").alias("note"), attr("lang").alias("lang"),
                         F.col("content").alias("payload"))


# ---------------------------------------------------------------- missing values
@register("label_missing", sql="""
SELECT d.doc_id, l.quality IS NULL AS label_missing,
       CASE WHEN l.quality IS NULL THEN 'unlabelled' ELSE CAST(l.quality AS VARCHAR) END AS quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def label_missing(spark: SparkSession, root: str) -> DataFrame:
    """Documents without a label flagged missing, with a default label."""
    docs = table(spark, root, "documents").select("doc_id")
    labels = table(spark, root, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    joined = lookup(docs, labels, "doc_id", "doc_id", ["quality"])
    return joined.select("doc_id", is_missing("quality").alias("label_missing"),
                         default_if_empty("quality", "unlabelled").alias("quality"))


# ---------------------------------------------------------------- more paths end to end
@register("alert_failed_login", sql="""
SELECT * FROM (
  SELECT event_id, ts, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTES PRECEDING
                                      AND CURRENT ROW) AS n_recent
  FROM events WHERE event_type = 'error'
) WHERE n_recent > 5
""")
def alert_failed_login(spark: SparkSession, root: str) -> DataFrame:
    """More than 5 failed authentications (error events) in an hour, over all of
    them: no key, so the slices of time alone spread the work."""
    errors = table(spark, root, "events").filter(F.col("event_type") == "error").select("event_id", "ts")
    return threshold_alert(errors, None, "ts", "60 minutes", more_than=5)


@register("store_written", sql=ORACLE["store_replace"])
def store_written(spark: SparkSession, root: str) -> DataFrame:
    """Store by directory with replace, twice (a replayed write), then read back."""
    ev = table(spark, root, "events").select(
        F.col("event_type").alias("directory"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("filename"),
        "event_id", F.col("ts").alias("created_at"), "value")
    path = work_dir(spark, "store_written")
    order = ["created_at", "event_id"]
    for _ in range(2):
        store(ev, path, "directory", "filename", order=order)
    return read_store(spark, path, "directory", "filename", order=order).select(
        "directory", "filename", "event_id", "created_at", "value")


def _event_files(events: DataFrame) -> DataFrame:
    """One stored file per event type and user."""
    return events.select(
        F.col("event_type").alias("directory"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("filename"),
        "event_id", F.col("ts").alias("created_at"), "value")


def _three_deliveries(spark: SparkSession, root: str, name: str) -> GenerationStore:
    """Events delivered by time of day, night, day and evening; the day's delivery comes twice and a merge follows it."""
    ev = table(spark, root, "events")
    held = GenerationStore(spark, work_dir(spark, name), "directory", "filename", ("created_at", "event_id"))
    hour = F.hour("ts")
    held.append(_event_files(ev.filter(hour < 8)), 0)
    for _ in range(2):
        held.append(_event_files(ev.filter((hour >= 8) & (hour < 16))), 1)
    held.merge()
    held.append(_event_files(ev.filter(hour >= 16)), 2)
    return held


@register("store_generations", sql=ORACLE["store_replace"])
def store_generations(spark: SparkSession, root: str) -> DataFrame:
    """The replace store over three deliveries, one of them repeated, and one merge:
    the generation's rows with the last delivery resolved on top."""
    return _three_deliveries(spark, root, "store_generations").read()


@register("store_generation_directory", sql=f"SELECT * FROM ({ORACLE['store_replace']}) WHERE directory IN ('purchase', 'error')")
def store_generation_directory(spark: SparkSession, root: str) -> DataFrame:
    """Two directories of the merged store: their live folders alone are scanned."""
    held = _three_deliveries(spark, root, "store_generation_directory")
    held.merge()
    return held.read(["purchase", "error"])


@register("stream_store_generations", sql=ORACLE["store_replace"])
def stream_store_generations(spark: SparkSession, root: str) -> DataFrame:
    """The table's files stream into the generation store, merged after every micro-batch."""
    base = work_dir(spark, "stream_store_generations")
    held = GenerationStore(spark, f"{base}/store", "directory", "filename", ("created_at", "event_id"))
    ev = _event_files(stream_table(spark, root, "events", max_files_per_trigger=1))
    run_to_end(start_batches(ev, held.sink("events", merge_every=1), f"{base}/checkpoint", available_now=True))
    return held.read()


@register("request_landing_intake", sql=_PARAMS_CTE + """
, en AS (
  SELECT page_id, url, html FROM pages
  WHERE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '/en'
     OR starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/en/')
), routed AS (
  SELECT en.page_id, en.html, 'feed' AS rel FROM en JOIN firsts f
    ON f.page_id = en.page_id AND f.key = 'http.query.param.utm_source' AND f.value = 'feed'
  UNION ALL
  SELECT en.page_id, en.html, 'paged' FROM en JOIN firsts f
    ON f.page_id = en.page_id AND f.key = 'http.query.param.page'
)
SELECT CAST(page_id AS VARCHAR) AS record_id, rel AS category, 'en' AS x_lang,
       false AS has_content_type, CAST(strlen(html) AS BIGINT) AS size
FROM routed
""")
def request_landing_intake(spark: SparkSession, root: str) -> DataFrame:
    """Pages land as captured POST requests (JSON lines), are read back as
    requests, taken in under /en with X-* headers as attributes, and routed."""
    landing = _land_requests(spark, root, "request_landing")
    recs = intake(read_requests(spark, landing), base_path="en", header_regex="X-.*",
                  record_id=F.col("headers")["X-Page-Id"])
    routed = route(recs, {"feed": equals(attr("http.query.param.utm_source"), "feed"),
                          "paged": attr("http.query.param.page").isNotNull()}, prefilter=False)
    return routed.select("record_id", F.col("relationship").alias("category"),
                         attr("X-Lang").alias("x_lang"),
                         F.map_contains_key("attributes", "Content-Type").alias("has_content_type"),
                         "size")


def _landed_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages as captured POST requests."""
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"),
                           F.lit("X-Page-Id"), F.col("page_id").cast("string"),
                           F.lit("X-Lang"), F.regexp_extract("url", "^[a-z]+://[^/]*/([a-z]{2})(/|$)", 1))
    return table(spark, root, "pages").select(
        F.lit("POST").alias("method"), "url", headers.alias("headers"), F.col("html").alias("body"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("received_at"))


def _land_requests(spark: SparkSession, root: str, name: str) -> str:
    """The requests in a landing folder of JSON lines."""
    landing = work_dir(spark, name)
    _landed_pages(spark, root).write.json(landing)
    return landing


@register("stream_request_store", sql=_PARAMS_CTE + """
, routed AS (
  SELECT p.page_id, p.html, 'feed' AS rel FROM pages p JOIN firsts f
    ON f.page_id = p.page_id AND f.key = 'http.query.param.utm_source' AND f.value = 'feed'
  UNION ALL
  SELECT p.page_id, p.html, 'paged' FROM pages p JOIN firsts f
    ON f.page_id = p.page_id AND f.key = 'http.query.param.page'
)
SELECT rel AS category, CAST(page_id AS VARCHAR) || '.' || rel AS filename,
       CAST(page_id AS VARCHAR) AS record_id, 'output/' || rel AS directory,
       CAST(strlen(html) AS BIGINT) AS size
FROM routed
""")
def stream_request_store(spark: SparkSession, root: str) -> DataFrame:
    """The whole flow on a stream: landing folder, intake, route by query parameter,
    update per branch, replace store; read back from the store."""
    landing, path = _land_requests(spark, root, "stream_request_landing"), work_dir(spark, "stream_request_store")
    rules = {"feed": equals(attr("http.query.param.utm_source"), "feed"),
             "paged": attr("http.query.param.page").isNotNull()}
    flow = (Flow("requests")
            .add("landing", "table", frame=read_requests(spark, landing, stream=True))
            .add("intake", "intake", base_path="/", header_regex="X-.*",
                 record_id=F.col("headers")["X-Page-Id"])
            .add("route", "route", auto_terminate=["unmatched"], rules=rules)
            .connect("landing", "intake").connect("intake", "route")
            .add("store", "store", path=path, by="category", filename="filename"))
    for branch in rules:
        flow.add(f"update_{branch}", "update", assignments={
            "category": F.lit(branch), "filename": append(F.col("record_id"), "." + branch),
            "directory": F.lit(f"output/{branch}")})
        flow.connect("route", f"update_{branch}", [branch]).connect(f"update_{branch}", "store")
    runner = flow.runner(spark, available_now=True, checkpoint_root=work_dir(spark, "stream_request_checkpoints"))
    summary = runner.start()
    if summary["failed"]:
        raise RuntimeError(str(runner.errors))
    runner.await_all()
    return read_store(spark, path, "category", "filename").select(
        "category", "filename", "record_id", "directory", "size")


@register("running_balance", sql="""
WITH e AS (
  SELECT event_id, event_type, ts, CAST(round(value * 100) AS BIGINT) - 5000 AS cents FROM events
)
SELECT event_id, event_type, cents,
       CAST(sum(cents) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance
FROM e
""")
def running_balance(spark: SparkSession, root: str) -> DataFrame:
    """A signed running total per event type (cents above or below 50)."""
    ev = table(spark, root, "events").select(
        "event_id", "event_type", "ts",
        (F.round(F.col("value") * 100).cast("bigint") - 5000).alias("cents"))
    out = running_totals(ev, ["event_type"], ["ts", "event_id"], {"balance": "cents"})
    return out.select("event_id", "event_type", "cents", "balance")


@register("store_numeric_dirs", sql="""
SELECT lpad(CAST(user_id % 12 AS VARCHAR), 2, '0') AS directory, 'user_' || CAST(user_id AS VARCHAR) AS filename,
       arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS created_at
FROM events GROUP BY 1, 2
""")
def store_numeric_dirs(spark: SparkSession, root: str) -> DataFrame:
    """Folders whose names look like numbers come back as the text they were."""
    ev = table(spark, root, "events").select(
        F.lpad((F.col("user_id") % 12).cast("string"), 2, "0").alias("directory"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("filename"),
        "event_id", F.col("ts").alias("created_at"))
    path, order = work_dir(spark, "store_numeric_dirs"), ["created_at", "event_id"]
    store(ev, path, "directory", "filename", order=order)
    return read_store(spark, path, "directory", "filename", order=order).select(
        "directory", "filename", "event_id", "created_at")


@register("drop_secret_attributes", sql="""
SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, false AS has_token, 2 AS n_attrs FROM events
""")
def drop_secret_attributes(spark: SparkSession, root: str) -> DataFrame:
    """Attributes with secret names (any case) are dropped before logging."""
    attrs = drop_secret_keys(F.create_map(
        F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"),
        F.lit("Token"), F.md5(F.col("props")), F.lit("password"), F.col("props")))
    ev = table(spark, root, "events").select("event_id", attrs.alias("attributes"))
    return ev.select("event_id", attr("event_type").alias("event_type"), attr("user_id").alias("user_id"),
                     F.map_contains_key("attributes", "Token").alias("has_token"),
                     F.size("attributes").alias("n_attrs"))


@register("stream_byte_cap", sql=ORACLE["route_and_store"])
def stream_byte_cap(spark: SparkSession, root: str) -> DataFrame:
    """The byte cap: micro-batches of at most about 1 MB of the table's files."""
    ev = stream_table(spark, root, "events", max_bytes_per_trigger="1 MB")
    out = _flagship_columns(route_and_update(ev, _flagship_rules(), filename=F.col("event_id").cast("string"),
                                             now=F.col("ts")))
    return spark.read.schema(out.schema).parquet(_drain(spark, "stream_byte_cap", out))


@register("stream_restart", sql=ORACLE["route_and_store"])
def stream_restart(spark: SparkSession, root: str) -> DataFrame:
    """Durable position: a second start on the same checkpoint adds nothing twice."""
    ev = stream_table(spark, root, "events", max_files_per_trigger=1)
    out = _flagship_columns(route_and_update(ev, _flagship_rules(), filename=F.col("event_id").cast("string"),
                                             now=F.col("ts")))
    base = work_dir(spark, "stream_restart")
    for _ in range(2):
        run_to_end(start_file_sink(out, f"{base}/out", f"{base}/checkpoint", available_now=True))
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@register("stream_capped_route", sql=ORACLE["route_and_store"])
def stream_capped_route(spark: SparkSession, root: str) -> DataFrame:
    """The stream takes at most one of the table's files per micro-batch (the object
    back-pressure cap), routes, updates and stores."""
    base = work_dir(spark, "stream_capped_route")
    ev = stream_table(spark, root, "events", max_files_per_trigger=1)
    rules = _flagship_rules()
    out = route_and_update(ev, rules, filename=F.col("event_id").cast("string"), now=F.col("ts"))
    out = _flagship_columns(out)
    q = start_file_sink(out, f"{base}/out", f"{base}/checkpoint", partition_by=["category"],
                        available_now=True)
    run_to_end(q)
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@register("stream_store_replace", sql=ORACLE["store_replace"])
def stream_store_replace(spark: SparkSession, root: str) -> DataFrame:
    """The table's files stream, one a batch, into the replace store; the store is
    read back resolved."""
    base = work_dir(spark, "stream_store_replace")
    ev = stream_table(spark, root, "events", max_files_per_trigger=1).select(
        F.col("event_type").alias("directory"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("filename"),
        "event_id", F.col("ts").alias("created_at"), "value")
    order = ["created_at", "event_id"]
    run_to_end(store_stream(ev, f"{base}/store", "directory", "filename", f"{base}/checkpoint",
                            order=order, available_now=True))
    return read_store(spark, f"{base}/store", "directory", "filename", order=order).select(
        "directory", "filename", "event_id", "created_at", "value")


ROUTE_AND_STORE_SPEC = {
    "name": "route_and_store_spec",
    "stages": [
        {"name": "intake", "type": "table", "properties": {"frame": {"frame": "events"}}},
        {"name": "route", "type": "route", "auto_terminate": ["unmatched"],
         "properties": {"rules": {"large": {"expr": "event_type = 'purchase'"},
                                  "small": {"expr": "event_type = 'click'"}}}},
        *[{"name": f"update_{b}", "type": "update", "properties": {"assignments": {
            "category": {"expr": f"'{b}'"},
            "processing_time": {"expr": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')"},
            "filename": {"expr": f"concat(coalesce(cast(event_id AS STRING), ''), '.{b}')"},
            "directory": {"expr": f"'output/{b}'"}}}} for b in ("large", "small")],
        {"name": "store", "type": "store", "properties": {"by": "category", "filename": "filename",
                                                          "order": ["ts", "event_id"]}},
    ],
    "connections": [
        {"source": "intake", "destination": "route"},
        {"source": "route", "destination": "update_large", "relationships": ["large"]},
        {"source": "route", "destination": "update_small", "relationships": ["small"]},
        {"source": "update_large", "destination": "store"},
        {"source": "update_small", "destination": "store"},
    ],
}


def _log_and_store_flow(source: DataFrame, store_path: str) -> Flow:
    """One route with two ends: a log of the routed records, and the replace store of the updated ones."""
    flow = route_and_store_flow(source, _flagship_rules(), filename=F.col("event_id").cast("string"), now=F.col("ts"),
                                store_path=store_path, order=("ts", "event_id"))
    flow.add("ids", "update", assignments={"record_id": F.col("event_id").cast("string")})
    flow.add("log", "log", level="info", columns={"event_type": F.col("event_type"), "user_id": F.col("user_id")})
    return flow.connect("route", "ids", ["large", "small"]).connect("ids", "log")


def _shared_run(spark: SparkSession, root: str, name: str) -> tuple[Flow, str]:
    """The flow above as one streaming query over the events: each micro-batch is read once for both ends."""
    base = work_dir(spark, name)
    flow = _log_and_store_flow(stream_table(spark, root, "events", max_files_per_trigger=1), f"{base}/store")
    run_to_end(start_shared(flow, spark, f"{base}/staging", f"{base}/checkpoint",
                            {"log": {"path": f"{base}/log", "format": "parquet"}}, merge_every=1, available_now=True))
    return flow, base


@register("flow_shared_store", sql=ORACLE["route_and_store"])
def flow_shared_store(spark: SparkSession, root: str) -> DataFrame:
    """Log and store behind one route, run as one query; the store."""
    flow, _ = _shared_run(spark, root, "flow_shared_store")
    return _flagship_columns(store_of(spark, flow, "store").read())


@register("flow_shared_log", sql="""
SELECT CAST(event_id AS VARCHAR) AS record_id, 'info' AS level,
       'Logging record ' || event_id || chr(10) || 'Record attributes' || chr(10) || 'Key: ''event_type''' || chr(10)
         || '  Value: ''' || event_type || '''' || chr(10) || 'Key: ''user_id''' || chr(10)
         || '  Value: ''' || user_id || '''' AS line
FROM events WHERE event_type IN ('purchase', 'click')
""")
def flow_shared_log(spark: SparkSession, root: str) -> DataFrame:
    """Log and store behind one route, run as one query; the log."""
    _, base = _shared_run(spark, root, "flow_shared_log")
    return spark.read.parquet(f"{base}/log").select("record_id", "level", "line")


@register("flow_from_spec", sql=ORACLE["route_and_store"])
def flow_from_spec(spark: SparkSession, root: str) -> DataFrame:
    """The route-and-store flow declared as data (stages, properties as Spark SQL
    expressions, connections by relationship), compiled by ``Flow.from_spec``, run
    and read back from its store."""
    flow = Flow.from_spec(ROUTE_AND_STORE_SPEC, {"events": table(spark, root, "events")})
    path = work_dir(spark, "flow_from_spec")
    flow.stages["store"].props["path"] = path
    return _run_and_read(spark, flow, path)


@register("token_age_check", sql="""
SELECT event_id, user_id, ts < TIMESTAMP '2024-01-30 04:00:00' AS stale
FROM events
""")
def token_age_check(spark: SparkSession, root: str) -> DataFrame:
    """An 8-hour token life: flag every event older than 8 hours at a fixed now."""
    ev = table(spark, root, "events").select("event_id", "user_id", "ts")
    return ev.select("event_id", "user_id",
                     older_than("ts", "8 hours", now="2024-01-30 12:00:00").alias("stale"))


@register("store_rejects", sql="""
SELECT event_id, user_id, CAST(NULL AS VARCHAR) AS directory FROM events WHERE event_type = 'error'
""")
def store_rejects(spark: SparkSession, root: str) -> DataFrame:
    """The failure relationship of the store: records without a directory (here
    error events) are not stored; ``store`` hands them back."""
    ev = table(spark, root, "events").select(
        "event_id", "user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("directory"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("filename"),
        F.col("ts").alias("created_at"))
    rejects = store(ev, work_dir(spark, "store_rejects"), "directory", "filename",
                    order=["created_at", "event_id"])
    return rejects.select("event_id", "user_id", "directory")


@register("stream_queue_depth", sql="""
SELECT event_type AS queue, count(*) AS total_objects, CAST(sum(strlen(props)) AS BIGINT) AS total_bytes,
       count(*) >= 1000 OR sum(strlen(props)) >= 20480 AS limit_reached
FROM events GROUP BY event_type
""")
def stream_queue_depth(spark: SparkSession, root: str) -> DataFrame:
    """The table's files stream, one a batch, into running totals per queue;
    the latest snapshot per queue is read back."""
    base = work_dir(spark, "stream_queue_depth")
    ev = stream_table(spark, root, "events", max_files_per_trigger=1)
    depth = queue_depth_stream(ev, "event_type", F.octet_length("props"), max_objects=1000,
                               max_bytes="20 KB")
    run_to_end(start_snapshot_sink(depth, f"{base}/snapshots", f"{base}/checkpoint",
                                   available_now=True))
    return latest_depth(spark, f"{base}/snapshots")


@register("stream_error_periods", sql="""
SELECT date_trunc('hour', ts) AS period_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS period_end,
       count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors
FROM events GROUP BY 1, 2
""")
def stream_error_periods(spark: SparkSession, root: str) -> DataFrame:
    """Hourly event and error counts from the event stream: the last counts of
    each hour, also of those the watermark has not closed."""
    ev = stream_table(spark, root, "events").select("ts", "event_type")
    periods = error_counts_stream(ev, "ts", F.col("event_type") == "error", "1 hour", "30 minutes")
    return _last_rows(spark, "stream_error_periods", periods, "period_start", "period_end")


@register("stream_threshold_exact", sql=ORACLE["alert_threshold"])
def stream_threshold_exact(spark: SparkSession, root: str) -> DataFrame:
    """The trailing count of every event from keyed state; the last count of each event is read back."""
    ev = stream_table(spark, root, "events").select("event_id", "event_type", "ts")
    counts = trailing_counts(ev, "event_type", "ts", "event_id", "30 minutes", "10 minutes")
    last = _last_rows(spark, "stream_threshold_exact", counts, "event_id")
    return last.filter("n_recent > 2").select("event_id", "event_type", "ts", "n_recent")


@register("stream_error_spike", sql=ORACLE["error_rate_spike"])
def stream_error_spike(spark: SparkSession, root: str) -> DataFrame:
    """Hourly error rates against the 3 hours before, all in one streaming query; a
    heartbeat after the last event closes its hour."""
    base = work_dir(spark, "stream_error_spike")
    beat(spark, f"{base}/beats")
    ev = stream_table(spark, root, "events").select("ts", "event_type")
    spikes = error_spike_stream(ev, "ts", F.col("event_type") == "error", "1 hour", 3, 0.05, "30 minutes", f"{base}/beats")
    for at in (None, "2999-01-01 00:00:00"):
        if at:
            beat(spark, f"{base}/beats", at)
        run_to_end(start_file_sink(spikes, f"{base}/out", f"{base}/checkpoint", available_now=True))
    return spark.read.schema(spikes.schema).parquet(f"{base}/out")


@register("route_branch_updates", sql="""
SELECT event_id, 'large' AS relationship, 'large' AS category, 'L' AS tag, value FROM events
WHERE event_type = 'purchase'
UNION ALL
SELECT event_id, 'small', 'small', NULL, value FROM events WHERE event_type = 'click'
UNION ALL
SELECT event_id, 'big', 'big', NULL, value * 2 FROM events WHERE value > 90
""")
def route_branch_updates(spark: SparkSession, root: str) -> DataFrame:
    """Each branch updates its own columns, in one pass over the events (one
    CASE per column on the relationship), equal to stage-per-branch + fan-in."""
    ev = table(spark, root, "events").select("event_id", "event_type", "value")
    rules = {**_flagship_rules(), "big": F.col("value") > 90}
    out = route_update(ev, rules, {"large": {"category": "large", "tag": F.lit("L")},
                                   "small": {"category": "small"},
                                   "big": {"category": "big", "value": F.col("value") * 2}})
    return out.select("event_id", "relationship", "category", "tag", "value")


_RULES_SQL = """
WITH r AS (
  SELECT 'brand:' || p_brand AS rule, p_brand AS b, NULL AS t, NULL AS s FROM part GROUP BY p_brand HAVING min(p_size) = 1
  UNION ALL
  SELECT 'brand_type:' || p_brand || ':' || p_type, p_brand, p_type, NULL FROM part
  GROUP BY p_brand, p_type HAVING max(p_size) >= 45
  UNION ALL
  SELECT 'brand_size:' || p_brand || ':' || CAST(p_size AS VARCHAR), p_brand, NULL, p_size FROM part
  GROUP BY p_brand, p_size HAVING count(*) >= 2
), hit AS (
  SELECT p_partkey, rule FROM part JOIN r
    ON p_brand = b AND (t IS NULL OR p_type = t) AND (s IS NULL OR p_size = s)
)
"""


def _part_records(part: DataFrame) -> DataFrame:
    return to_records(part, "p_partkey", F.lit(None).cast("timestamp"),
                      attributes={"brand": "p_brand", "type": "p_type", "size": "p_size"}, keep=["p_partkey"])


def _part_rules(spark: SparkSession, root: str) -> DataFrame:
    """(rule, attribute, value): a rule per brand, brand and type, brand and size, as the parts have them."""
    part = table(spark, root, "part")
    kinds = [("brand", {"brand": "p_brand"}, F.min("p_size") == 1),
             ("brand_type", {"brand": "p_brand", "type": "p_type"}, F.max("p_size") >= 45),
             ("brand_size", {"brand": "p_brand", "size": "p_size"}, F.count(F.lit(1)) >= 2)]
    out = []
    for kind, columns, holds in kinds:
        rule = F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in columns.values()])
        conditions = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(c).cast("string").alias("value"))
                               for a, c in columns.items()])
        found = part.groupBy(*columns.values()).agg(holds.alias("holds")).filter("holds")
        out.append(found.select(rule.alias("rule"), F.inline(conditions)))
    return fan_in(*out)


def _part_rule_index(spark: SparkSession, root: str, name: str, counted: bool) -> DataFrame:
    base = work_dir(spark, name)
    _part_rules(spark, root).write.parquet(f"{base}/rules")
    rules = spark.read.parquet(f"{base}/rules")
    counts = condition_counts(_part_records(table(spark, root, "part")), rules) if counted else None
    rule_index(rules, counts).write.parquet(f"{base}/index")
    return spark.read.parquet(f"{base}/index")


@register("route_rule_table", sql=_RULES_SQL + """
SELECT p_partkey, rule AS relationship FROM hit
UNION ALL SELECT p_partkey, 'unmatched' FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM hit)
""")
def route_rule_table(spark: SparkSession, root: str) -> DataFrame:
    """Parts routed by a table of rules made from them (hundreds at sf0.01), each rule
    filed under the condition that the fewest parts meet, and the parts that no rule takes."""
    index = _part_rule_index(spark, root, "route_rule_table", counted=True)
    parts = _part_records(table(spark, root, "part"))
    routed = route_by_table(parts, index)
    return fan_in(routed, unmatched_by_table(parts, routed, ["p_partkey"])).select("p_partkey", "relationship")


@register("stream_route_rule_table", sql=_RULES_SQL + "SELECT p_partkey, rule AS relationship FROM hit")
def stream_route_rule_table(spark: SparkSession, root: str) -> DataFrame:
    """The same rules over a stream of parts: the index is a static table, no state is kept."""
    index = _part_rule_index(spark, root, "stream_route_rule_index", counted=False)
    routed = route_by_table(_part_records(stream_table(spark, root, "part")), index).select("p_partkey", "relationship")
    return spark.read.schema(routed.schema).parquet(_drain(spark, "stream_route_rule_table", routed))


@register("stream_intake_once", sql="""
SELECT CAST(page_id AS VARCHAR) AS record_id, CAST(strlen(html) AS BIGINT) AS size FROM pages
""")
def stream_intake_once(spark: SparkSession, root: str) -> DataFrame:
    """All pages are delivered twice to one landing folder, the second time after the
    stream took the first; each request is taken once."""
    base, landing = work_dir(spark, "stream_intake_once"), work_dir(spark, "stream_intake_landing")
    for _ in range(2):
        _landed_pages(spark, root).write.mode("append").json(landing)
        taken = intake(read_requests(spark, landing, stream=True), base_path="/", header_regex="X-.*",
                       record_id=F.col("headers")["X-Page-Id"])
        once = intake_once(taken, "1 day").select("record_id", "size")
        run_to_end(start_file_sink(once, f"{base}/out", f"{base}/checkpoint", available_now=True))
    return spark.read.schema(once.schema).parquet(f"{base}/out")


@register("log_search_indexed", sql=ORACLE["log_contains"])
def log_search_indexed(spark: SparkSession, root: str) -> DataFrame:
    """The same blocks as ``log_contains``, from a written log whose files are indexed: files
    of other event types are not read."""
    base = work_dir(spark, "log_search")
    recs = _event_records(spark, root)
    # Events of a type lie together, split by id where a type is large.
    by_type = recs.repartitionByRange(16, attr("event_type"), F.col("record_id"))
    write_log(log_lines(by_type), f"{base}/log")
    index_log(spark, f"{base}/log", f"{base}/index")
    found = search_log(spark, f"{base}/index", "Value: 'error'")
    return found.select(
        F.regexp_extract("line", r"^Logging record (\S+)", 1).alias("record_id"), "line")
