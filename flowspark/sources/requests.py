"""Captured requests (an HTTP intake re-aimed at a landing folder or table).

Requests land as JSON lines ``method, url, headers, body, received_at``; the
intake keeps those under the base path and turns headers (by regex) and query
parameters into attributes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.urls import QUERY_PARAM_PREFIX, header_attributes, query_params, under_base_path
from flowspark.records import ATTRIBUTES, CONTENT, CREATED_AT, RECORD_ID, SIZE, content_size

REQUEST_SCHEMA = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
    T.StructField("body", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
])


def read_requests(spark: SparkSession, path: str, stream: bool = False,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Landing folder of JSON-lines requests, as a batch or a stream."""
    if stream:
        r = spark.readStream.schema(REQUEST_SCHEMA)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.json(path)
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def rejected_requests(df: DataFrame, url: str = "url") -> DataFrame:
    """The intake's failure branch: requests without a URL, which nothing can route."""
    return df.filter(F.coalesce(F.trim(F.col(url)), F.lit("")) == "")


def intake(df: DataFrame, base_path: str, header_regex: str = ".*", url: str = "url",
           headers: str | None = "headers", body: str = "body", received_at: str = "received_at",
           record_id: str | Column | None = None, methods: tuple[str, ...] | None = ("POST",),
           method: str | None = "method") -> DataFrame:
    """Requests → records. Only requests under ``base_path`` (and of ``methods``)
    are taken; attributes = matching headers + ``http.query.param.*``. Requests
    without a URL are not taken: ``rejected_requests`` has them."""
    keep = under_base_path(url, base_path)
    if methods and method:
        keep = keep & F.upper(F.col(method)).isin([m.upper() for m in methods])
    params = query_params(url)
    if headers:
        hdr = F.map_filter(header_attributes(F.coalesce(F.col(headers), F.create_map().cast(
            "map<string,string>")), header_regex),
            lambda k, v: ~F.startswith(k, F.lit(QUERY_PARAM_PREFIX)))
        attrs = F.map_concat(hdr, params)
    else:
        attrs = params
    if isinstance(record_id, str):
        record_id = F.col(record_id)
    rid = record_id.cast("string") if record_id is not None else F.sha2(
        F.concat_ws("\u0001", F.col(url), F.col(received_at).cast("string"), F.col(body)), 256)
    return df.filter(keep).select(
        rid.alias(RECORD_ID), F.col(received_at).alias(CREATED_AT), attrs.alias(ATTRIBUTES),
        F.col(body).alias(CONTENT)).withColumn(SIZE, content_size(CONTENT))


def intake_once(df: DataFrame, delay: str, received_at: str = CREATED_AT, key: str = RECORD_ID) -> DataFrame:
    """Taken requests without repeated deliveries: the first of each ``key`` stays.

    On a stream a key is remembered until the watermark, ``delay`` behind the latest
    ``received_at``, has passed it; a request that comes later than that is
    late and not taken, so ``delay`` must cover how long a sender repeats. On a
    batch every repeat goes. A null key is no key: such requests are the same if
    time, attributes and content are. On a stream a request with a null time is
    remembered within its micro-batch only, so a repeat in a later one is taken
    again: fill the time before where a sender leaves it out.
    """
    same = F.when(F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key))).otherwise(F.concat(F.lit("r"), F.sha2(
        F.to_json(F.struct(F.col(received_at).alias("t"), F.array_sort(F.map_entries(ATTRIBUTES)).alias("a"),
                           F.col(CONTENT).alias("c"))), 256)))
    keyed = df.withColumn("__request", same)
    if df.isStreaming:
        kept = keyed.withWatermark(received_at, delay).dropDuplicatesWithinWatermark(["__request"])
    else:
        kept = keyed.dropDuplicates(["__request"])
    return kept.drop("__request")
