"""Corpus pipeline: STAGES run one after the other over ``documents``.

Every stage takes all rows its predecessor kept and returns the columns of
documents, but the last, which returns the tokenised documents. Defined results
follow the operators': null texts fail the quality rules, repeated rows share
their fate, a document emptied by line dedup stays as an empty one. Other
columns may have any name: they travel packed in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from flowspark.llm import bpe, decontamination, jaccard_join, line_dedup, quality_rules
from flowspark.session import work_dir
from flowspark.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def packed(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, text and ``also`` beside all other columns in one, so that no name meets an operator's own."""
    others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *also, F.struct(*(others or [F.lit(0).alias("c")])).alias("carried"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``packed`` was given, in their order."""
    return df.select(*[F.col(c) if c in ("doc_id", "text") else F.col("carried")[f"c{k}"].alias(c)
                       for k, c in enumerate(columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the tokeniser fertility keep."""
    judged = quality_rules.quality_rules(packed(docs, "lang"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                         public_tokenizers.PATTERN, carry=["text", "carried"])
    return unpacked(judged.filter("kept"), docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; ``n_chars`` follows the text."""
    left = unpacked(line_dedup.drop_recurring_lines(packed(docs)), docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else left


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each similarity component: the one with the least id, null ids last, then the least hash of
    its text. Rows equal in id and text are one document, and texts of one id are linked; documents without words stay."""
    groups = jaccard_join.document_components(packed(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first")
    leads = (groups.filter("component is not null").groupBy("component").agg(first)
             .select("first.doc_id", "first.text_hash")
             .union(groups.filter("component is null").select("doc_id", "text_hash"))
             .select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_text")))
    rows = packed(docs)
    kept = rows.join(leads, rows.doc_id.eqNullSafe(F.col("kept_id")) & (F.xxhash64(rows.text) == F.col("kept_text")), "left_semi")
    return unpacked(kept.dropDuplicates(["doc_id", "text"]), docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark passage contaminates."""
    rows = packed(docs)
    hits = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"))
    bad = hits.filter("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_text"))
    clean = rows.join(bad.distinct(), rows.doc_id.eqNullSafe(F.col("bad_id"))
                      & (F.xxhash64(rows.text) == F.col("bad_text")), "left_anti")
    return unpacked(clean, docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_copies),
    ("decontamination", decontaminated), ("bpe", encoded),
]

#: Tokenisation has no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_dir(spark, "corpus_pipeline", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
