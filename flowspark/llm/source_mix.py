"""Operator 12: mixing sources to target weights (DataFrame functions only).

Sizes are words per document, summed per source. The sources share a total of
``share`` times all words by weight; no target exceeds ``cap`` times its
source's size, and the excess goes to the others by weight until none is above.
That is one level ``l`` with ``sum(min(cap * size, l * weight)) = total``: with
the sources in order of size by weight, the capped ones come first, and a
source is capped when the level that is left after all before it would lift it
over its cap. Running totals in that order therefore settle every source in one
pass, in whole numbers, with no round per capped source.

A source's rate is its target by its size. Each document is taken floor(rate)
times, and once more when a hash of its id and text, read as a number in [0, 1),
is below the fraction: no state, so reruns and retried tasks agree.

Defined results: null and blank texts have size 0 and are taken as often as
their hash says, which adds no words; a null source is a source of its own and
comes last; rows with equal id and text share one draw; a source without words
has target and rate 0; the weights repeat over the sources in code-point order;
only id, source and text columns are read for the figures, and ``mix`` keeps all
columns of the documents, refusing those that bear a name it adds; an
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.tables import Scratch
from flowspark.operators.prefix import running_totals

#: The contract's weights in turn, share of all words and cap.
WEIGHTS = (5, 2, 1)
SHARE, CAP = "1.5", "2"
FIGURES = ["size", "source_size", "target", "taken", "copies"]


def n_words(text: Column) -> Column:
    """Runs of anything but the contract's blanks; null has none.

    Every run becomes one mark, so that no array of words is built for a very long text.
    """
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: str = SHARE, cap: str = CAP,
                   scratch: Scratch | None = None) -> DataFrame:
    """(source, source_size, target) of the columns (source, source_size), one row a source.

    Eager (each order's running totals are written). Whole numbers of up to 38
    digits decide who is capped; a target is rounded once.
    """
    scratch = scratch or Scratch(sizes.sparkSession, "source_targets")
    share, cap = Fraction(share), Fraction(cap)
    scale = math.lcm(share.denominator, cap.denominator)
    share_n, cap_n = int(share * scale), int(cap * scale)
    common = math.lcm(*weights)
    ranked = scratch.save(running_totals(sizes.withColumn("last", F.col("source").isNull().cast("int")), [],
                                         ["last", "source"], {"place": F.lit(1).cast("bigint")}), "ranked")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("bigint")
    weighed = ranked.withColumn("weight", weight).withColumn(
        "ratio", F.col("source_size").cast("decimal(28,0)") * (F.lit(common) / F.col("weight")).cast("bigint"))
    ordered = scratch.save(running_totals(weighed, [], ["ratio", "place"],
                                          {"size_upto": "source_size", "weight_upto": "weight"}), "ordered")
    every = ordered.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"),
                        F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    whole = lambda c: c.cast("decimal(38,0)")
    total = F.lit(int(every.s) * share_n).cast("decimal(38,0)")
    size, w = F.col("source_size"), F.col("weight")
    left = whole(total - whole((F.col("size_upto") - size) * F.lit(cap_n)))
    over = whole(size * F.lit(cap_n)) * (F.lit(int(every.w)) - F.col("weight_upto") + w) <= left * w
    settled = ordered.withColumn("capped", over)
    rest = settled.agg(F.coalesce(F.sum(F.when(F.col("capped"), size)), F.lit(0)).alias("s"),
                       F.coalesce(F.sum(F.when(~F.col("capped"), w)), F.lit(0)).alias("w")).first()
    level = F.lit(int(every.s) * share_n - int(rest.s) * cap_n).cast("decimal(38,0)")
    shared = whole(level * w).cast("double") / F.lit(float(scale * int(rest.w) or 1))
    capped = whole(size * F.lit(cap_n)).cast("double") / F.lit(float(scale))
    return settled.select("source", "source_size", F.when(F.col("capped"), capped).otherwise(shared).alias("target"))


def draw(id_col: str, text_col: str) -> Column:
    """A number in [0, 1) from the row's id and text: 52 bits of an MD5 digest."""
    seed = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                       F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: str = SHARE, cap: str = CAP) -> DataFrame:
    """``docs`` with size, source_size, target, taken and ``copies``, how often the mix takes the row.

    The join with the sources has no hint: it is broadcast if they are few,
    else a shuffle join that AQE splits where a source is hot.
    """
    clash = sorted(set(FIGURES) & set(docs.columns))
    if clash:
        raise ValueError(f"columns that mix adds: {clash}")
    scratch = Scratch(docs.sparkSession, "source_mix")
    sizes = scratch.save(docs.groupBy(F.col(source_col).cast("string").alias("source"))
                         .agg(F.sum(n_words(F.col(text_col))).alias("source_size")), "sizes")
    of = "of"
    while of in docs.columns:
        of += "_"
    targets = scratch.save(source_targets(sizes, weights, share, cap, scratch).withColumnRenamed("source", of), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (draw(id_col, text_col) < rate - F.floor(rate)).cast("bigint")).alias("copies")
    placed = (docs.withColumn("size", n_words(F.col(text_col)))
              .join(targets, F.col(source_col).cast("string").eqNullSafe(F.col(of))).drop(of))
    return placed.select("*", copies).withColumn("taken", F.col("size") * F.col("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, without the figures."""
    often = mixed.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return often.drop(*FIGURES)
