"""Intermediate tables in the shared folder: lineage ends at each of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import work_dir

FILTER_BITS = 22


class Scratch:
    """Tables of one run, each written once and read from the shared folder afterwards."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, work_dir(spark, name), 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def slots(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64) & ((1 << FILTER_BITS) - 1)


def key_filter(keys: DataFrame, column: str) -> bytes:
    """Packed bit table of a column of 64-bit hashes: 2**22 bits, whatever the number of keys.

    A key that is absent may pass by chance; a join on the key follows its use.
    """
    rows = keys.select(F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int").alias("s")).distinct()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[rows.toArrow().column(0).to_numpy()] = True
    return np.packbits(bits).tobytes()


class KeyBits:
    """A bit table of a column of 64-bit hashes with some 16 bits a key (2**28 at most), put together by Spark.

    A key that is absent may pass by chance. It is sent to the executors as bytes.
    """

    def __init__(self, keys: DataFrame, column: str, most: int = 1 << 28):
        self.size = min(most, max(1 << 15, 1 << (16 * keys.count() - 1).bit_length()))
        slot = F.col(column).bitwiseAND(F.lit(self.size - 1)) + 1
        rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()  # 32,768 slots a row
        table = np.zeros((self.size >> 15, 1 << 12), np.uint8)
        for r in rows:
            table[r.b - 1] = np.frombuffer(r.bits, np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(table.tobytes())

    def test(self, keys: np.ndarray) -> np.ndarray:
        at = keys & (self.size - 1)
        return np.frombuffer(self.sent.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def unpack(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


def components(edges: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): connected components over ``edges`` (a, b), beginning at ``labels`` (node, label).

    A label is the least node of its component, as far as the edges reach. Each
    round every label takes the least label that an edge of its members leads
    to, then labels are followed to their own labels until nothing moves; both
    are joins and minima, combined before each shuffle, so a node with very many edges
    is no task of its own.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes = both.select(F.col("a").alias("node")).distinct()
    labels = scratch.save(nodes.join(labels, "node", "left")
                          .select("node", F.coalesce("label", "node").alias("label")), "labels")
    while True:
        at_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        at_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        hooks = scratch.save(both.join(at_a, "a").join(at_b, "b").filter("la > lb")
                             .groupBy(F.col("la").alias("label")).agg(F.min("lb").alias("to")), "hooks")
        if hooks.isEmpty():
            return labels
        while True:  # a hook leads to a smaller label, which may be hooked itself
            onward = hooks.select(F.col("label").alias("to"), F.col("to").alias("onward"))
            jumped = scratch.save(hooks.join(onward, "to", "left")
                                  .select("label", "to", "onward"), "hooks")
            hooks = jumped.select("label", F.coalesce("onward", "to").alias("to"))
            if jumped.filter("onward is not null").isEmpty():
                break
        labels = scratch.save(labels.join(hooks, "label", "left")
                              .select("node", F.coalesce("to", "label").alias("label")), "labels")
