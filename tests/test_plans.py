"""Plan properties the design relies on (checked on the executed plan)."""

import re

import pytest

import __spark_entry__ as E
from flowspark.plans.catalog import QUERIES
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "FlatMapCoGroupsInPandas", "PythonUDF")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_is_one_pruned_scan_with_pushed_route(spark):
    plan = plan_of(E.queries()["route_and_store"](spark, SF_SMALL))
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan
    assert re.search(r"PushedFilters: \[.*EqualTo\(event_type,purchase\).*EqualTo\(event_type,click\)", plan)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "value" not in schema  # unused column pruned at the scan


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith("stream_")])
def test_no_python_in_plans(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert not any(node in plan for node in PYTHON_NODES), name


def test_replace_aggregates_before_shuffle(spark):
    plan = plan_of(E.queries()["store_replace"](spark, SF_SMALL))
    assert "partial_max_by" in plan  # map-side combine: a hot key shrinks before the exchange


def test_spike_scans_events_once(spark):
    plan = plan_of(E.queries()["error_rate_spike"](spark, SF_SMALL))
    assert plan.count("FileScan") == 1


def test_query_parameters_are_built_once(spark):
    for name in ("request_query_params", "request_route_by_param", "request_landing_intake"):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("map_from_entries") <= 1, name


def test_stored_flow_scans_its_source_once(spark):
    from pyspark.sql import functions as F

    from flowspark.plans.catalog import _flagship_rules
    from flowspark.plans.presets import route_and_store_flow
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    flow = route_and_store_flow(ev, _flagship_rules(), filename=F.col("event_id").cast("string"), now=F.col("ts"))
    plan = flow.plan(spark)["store"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
