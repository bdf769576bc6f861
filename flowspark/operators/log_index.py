"""Search in a log that skips files: a bit table of byte triples beside each file.

The log stays plain text. Beside it lies a table with one bit per hashed triple
of neighbouring bytes (in UTF-8) that occurs in a file's blocks, built by Spark's own
bitmap aggregate from the triples that each task found in its blocks. A search asks the table first: a file without a triple of the
text cannot hold the text. The files that are left are scanned and every block is
tested, so a bit set by chance costs a file read and not a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.sources.logs import read_log_blocks

GRAM = 3
BITS = 1 << 20  # per file: 32 bitmaps of Spark's 32,768 bits, 128 KB in all
CHUNK = 1 << 22  # bytes of a file's blocks looked at together


def _paths(files: list[str]) -> list[str]:
    """Spark names files by encoded addresses; its readers want plain paths."""
    return [unquote(f) for f in files]


def _one_form(file: Column) -> Column:
    """``file:///a`` and ``file:/a`` are one file: Spark's listing and its file column differ in that."""
    return F.regexp_replace(file, "^([^:/]+):///", "$1:/")


def _slot(code: Column) -> Column:
    return F.xxhash64(code).bitwiseAND(F.lit(BITS - 1))


def _triples(blocks: DataFrame) -> DataFrame:
    """(file, code) of the columns (file, line): the byte triples of each file's blocks, as numbers; each once
    for a batch of blocks, whatever their number and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + len(lines) + 1]
            data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)
            file = pc.dictionary_encode(batch.column(0)).indices.to_numpy()
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(file)) + 1, [len(file)]])
            for i, j in zip(bounds[:-1], bounds[1:]):  # blocks of one file lie together
                seen = np.zeros(1 << 8 * GRAM, bool)
                for at in range(offsets[i], offsets[j], CHUNK):
                    part = data[at:min(at + CHUNK + GRAM - 1, offsets[j])].astype(np.int32)
                    n = max(len(part) - GRAM + 1, 0)
                    whole = np.ones(n, bool)  # the triple does not run into the next block
                    for k in range(1, GRAM):
                        cut = offsets[i + 1:j + 1] - k - at
                        whole[cut[(cut >= 0) & (cut < n)]] = False
                    seen[sum(part[k:n + k] << 8 * k for k in range(GRAM))[whole]] = True
                codes = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(batch.column(0)[int(i)], len(codes)), pa.array(codes, pa.int64())], ["file", "code"])

    return blocks.mapInArrow(run, "file string, code bigint")


def gram_table(blocks: DataFrame, file: str = "file", line: str = "line") -> DataFrame:
    """(file, bucket, bits): the triples of each file's blocks; a file without any has no row.

    (file, triple) pairs are made distinct before a file's bits are set, so the blocks of
    one large file are spread over tasks, and at most ``BITS`` rows of it meet in one.
    """
    triples = _triples(blocks.select(F.col(file).alias("file"), F.col(line).alias("line")))
    slots = triples.select(_one_form(F.col("file")).alias(file), _slot(F.col("code")).alias("slot")).distinct()
    return (slots.groupBy(file, F.bitmap_bucket_number("slot").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")))


def index_log(spark: SparkSession, path: str, index_path: str, head: str = "Logging record ") -> None:
    """Add to ``index_path`` the files of the log at ``path`` that it does not hold yet.

    Log files are never changed, so a file is read for its index once. The list of indexed
    files is a table of its own, since a file may hold no triple. A file that two
    runs index at once has its rows twice, which a search does not mind.
    """
    # names from Spark's own listing; nothing is scanned
    listed = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string")
    listed = listed.select(_one_form(F.col("file")).alias("file"))
    try:
        known = spark.read.parquet(f"{index_path}/files")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        listed = listed.join(known, "file", "left_anti")
    todo = [r.file for r in listed.collect()]
    if not todo:
        return
    blocks = read_log_blocks(spark, _paths(todo), head=head, file="file")
    gram_table(blocks).write.mode("append").parquet(f"{index_path}/grams")
    spark.createDataFrame([(f,) for f in todo], "file string").write.mode("append").parquet(f"{index_path}/files")


def files_with(spark: SparkSession, index_path: str, text: str) -> DataFrame:
    """(file): the indexed files that can hold ``text``; all of them if it has fewer than three bytes."""
    data = text.encode()
    codes = {int.from_bytes(data[i:i + GRAM], "little") for i in range(len(data) - GRAM + 1)}
    asked = spark.createDataFrame([(c,) for c in codes], "code bigint").select(_slot(F.col("code")).alias("slot")).select(
        F.bitmap_bucket_number("slot").alias("bucket"), F.bitmap_bit_position("slot").alias("bit"))
    wanted = [(r.bucket, r.bit) for r in asked.distinct().collect()]  # as many as the text has characters
    files = spark.read.parquet(f"{index_path}/files").distinct()
    if not wanted:
        return files
    bits = spark.createDataFrame(wanted, "bucket bigint, bit bigint")
    byte = F.conv(F.hex(F.substr("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) != 0
    holds = (spark.read.parquet(f"{index_path}/grams").filter(F.col("bucket").isin(sorted({b for b, _ in wanted})))
             .join(bits, "bucket").filter(is_set).select("file", "bucket", "bit").distinct()
             .groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)))
    return files.join(holds, "file", "left_semi")


def search_log(spark: SparkSession, index_path: str, text: str, head: str = "Logging record ") -> DataFrame:
    """(line): the blocks of the indexed files that contain ``text``; only files that can hold it are scanned."""
    paths = [r.file for r in files_with(spark, index_path, text).collect()]  # file names only
    if not paths:
        return spark.createDataFrame([], "line string")
    return read_log_blocks(spark, _paths(paths), head=head).filter(F.col("line").contains(text))
