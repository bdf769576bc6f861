"""Application log as lines (batch or followed as a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, stream: bool = False, whole_file: bool = False) -> DataFrame:
    """``value STRING`` per line, or per file with ``whole_file``."""
    if stream:
        return spark.readStream.text(path, wholetext=whole_file)
    return spark.read.text(path, wholetext=whole_file)


def read_log_blocks(spark: SparkSession, path: str | list[str], stream: bool = False, head: str = "Logging record ",
                    file: str | None = None) -> DataFrame:
    """``line STRING``: one row per log block, as ``log_lines`` wrote it (batch or stream);
    ``file`` names a column for the path of the block's file.

    The text source splits where a line begins with ``head``; a block's own
    texts hold no line end, so they cannot begin one.
    """
    reader = spark.readStream if stream else spark.read
    raw = F.rtrim(F.col("value"), F.lit("\n"))
    line = F.when(F.startswith(raw, F.lit(head)), raw).otherwise(F.concat(F.lit(head), raw))
    where = [F.col("_metadata.file_path").alias(file)] if file else []
    return reader.option("lineSep", "\n" + head).text(path).select(line.alias("line"), *where)
