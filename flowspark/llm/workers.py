"""Arrow maps whose Python workers can import this library."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def import_path(spark: SparkSession) -> None:
    """Put the folder that holds the library on the PYTHONPATH of the workers of later Python functions.

    The folder is where the driver imported the library from; executors need it
    there or on their own path, as any installed library.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``df.mapInArrow`` whose workers can import the library."""
    import_path(df.sparkSession)
    return df.mapInArrow(run, schema)
