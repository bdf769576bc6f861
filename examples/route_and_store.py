"""The route-and-store flow: captured requests → route on a query parameter →
per-branch attribute update → store by category with replace.

Usage: python examples/route_and_store.py [sf_dir]
Requests are made from the pages table (each page URL is a captured POST whose
body is the page) and land as JSON lines; they are then processed as a stream
into the replace store and read back.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from flowspark import attr  # noqa: E402
from flowspark.functions import equals  # noqa: E402
from flowspark.operators import read_store  # noqa: E402
from flowspark.plans.presets import route_and_update  # noqa: E402
from flowspark.session import build_session, work_dir  # noqa: E402
from flowspark.sources import REQUEST_SCHEMA, intake, table  # noqa: E402
from flowspark.streaming import run_to_end, store_stream  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[4]", app="route-and-store")
    base = work_dir(spark, "example_route_and_store")
    pages = table(spark, sf, "pages")
    pages.select(F.lit("POST").alias("method"), "url",
                 F.create_map(F.lit("X-Page-Id"), F.col("page_id").cast("string")).alias("headers"),
                 F.col("html").alias("body"),
                 F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("received_at")
                 ).repartition(4).write.json(f"{base}/landing")

    requests = spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", 1).json(f"{base}/landing")
    records = intake(requests, base_path="en", header_regex="X-.*", record_id=F.col("headers")["X-Page-Id"])
    rules = {"feed": equals(attr("http.query.param.utm_source"), "feed"),
             "paged": attr("http.query.param.page").isNotNull()}
    routed = route_and_update(records, rules, filename=F.col("record_id"), root=f"{base}/output")
    q = store_stream(routed.drop("attributes"), f"{base}/store", "category", "filename",
                     f"{base}/checkpoint", available_now=True)
    run_to_end(q)
    stored = read_store(spark, f"{base}/store", "category", "filename")
    stored.groupBy("category").count().orderBy("category").show()
    spark.stop()


if __name__ == "__main__":
    main()
