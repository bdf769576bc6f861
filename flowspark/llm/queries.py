"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from flowspark.llm import bpe, chat_format, decontamination, hard_negatives, jaccard_join, kn_quality, language_id, line_dedup, oracles, pii, quality_rules, source_mix, spelling, suffix_dedup
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


@register("op1_language_id")
def op1_language_id(spark: SparkSession, root: str) -> DataFrame:
    """Language of every document; documents whose id's crc32 is 2 modulo 4 are held out of training."""
    docs = table(spark, root, "documents")
    training = language_id.training_texts(docs, ~language_id.held_out())
    return (language_id.predict_language(docs, training)
            .select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "phrases"))


@register("op2_line_dedup", sql=oracles.LINE_DEDUP)
def op2_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Every document without the lines of templates that recur across documents."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    return line_dedup.drop_recurring_lines(docs)


@register("op3_chat_format", sql=oracles.CHAT_FORMAT)
def op3_chat_format(spark: SparkSession, root: str) -> DataFrame:
    """Every conversation, and one made of control strings, formatted and read back."""
    text = "\\### Assistant: </turn> ok"
    control = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                    "conv_id long, turn long, role string, text string")
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(chat_format.format_chats(
        chat_format.text_parts(rows.unionByName(control))))


@register("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    """Base rules and tokeniser fertility of every document, and the verdict."""
    return quality_rules.quality_rules(table(spark, root, "documents"),
                                       public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                       public_tokenizers.PATTERN)


@register("op5_decontamination", sql=oracles.DECONTAMINATION)
def op5_decontamination(spark: SparkSession, root: str) -> DataFrame:
    """Benchmark windows that occur in every document."""
    return decontamination.decontaminate(table(spark, root, "documents"), table(spark, root, "benchmark")
                                         ).drop("text_hash")


@register("op6_bpe_automaton")
def op6_bpe_automaton(spark: SparkSession, root: str) -> DataFrame:
    """Every document encoded and decoded with the word-end vocabulary."""
    return bpe.encode_digests(table(spark, root, "documents"),
                              public_tokenizers.path("word_bpe_49k.json"))


@register("op7_pii")
def op7_pii(spark: SparkSession, root: str) -> DataFrame:
    """Personal data in every document."""
    return pii.pii_digests(table(spark, root, "documents"))


@register("op8_jaccard_join", sql=oracles.JACCARD_JOIN)
def op8_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    """Components of all documents under 4-word shingle similarity of 85 in 100."""
    return jaccard_join.similarity_components(table(spark, root, "documents"))


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of all documents outside repeated 400-byte strings."""
    return suffix_dedup.remove_repeats(table(spark, root, "documents"))


@register("op10_kn_quality")
def op10_kn_quality(spark: SparkSession, root: str) -> DataFrame:
    """Perplexity of every document under its language's model of the documents labelled good."""
    trusted = table(spark, root, "labels").filter("quality = 1").select("doc_id")
    return kn_quality.perplexity_quality(table(spark, root, "documents"), trusted)


@register("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    """Frequent forms and roots of every word of all documents."""
    return spelling.spelling_variants(table(spark, root, "documents"))


@register("op12_source_mix", sql=oracles.SOURCE_MIX)
def op12_source_mix(spark: SparkSession, root: str) -> DataFrame:
    """How often the mix takes every document, by its source's target."""
    docs = table(spark, root, "documents").select("doc_id", "source", "text")
    return source_mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


@register("op13_hard_negatives", sql=oracles.HARD_NEGATIVES)
def op13_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    """Hard negatives of every anchor and positive; labels of ids that 7 divides are moved on first."""
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(table(spark, root, "embeddings").withColumn("label", moved))
