"""Operator 2: line dedup with a log-template tree.

A line is parsed down a tree of fixed depth: its token count, then its first
``DEPTH`` tokens, where a token with a digit is the variable field ``<*>``. In
the leaf, positions are generalised by counts: a token stays in the template if
at least ``min_docs`` (document, line) pairs of the leaf hold it at that place, else the
place is variable. A line whose template would keep less than ``SIMILAR`` of its tokens
stays as it was parsed. So templates follow from counts, not from the order in which
lines arrive, and every step is a sum that is combined before its shuffle: no leaf is
gathered, however many lines it holds.

A template is recurring if ``min_docs`` documents or more hold it. Its lines are
dropped from all documents but the one with the least id, so that text which
only ever occurs in copies is not lost altogether.

Defined results: null text stays null, empty text stays empty, with one line;
blank lines have no template and stay; documents are never removed, a document may
keep no line (its text is then empty); a document is (id, text), so repeated rows
count once and get the same result; a null id is never the least; every column of
the table is returned, and may have any name; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.tables import Scratch, key_filter, unpack
from flowspark.llm.textbytes import slices
from flowspark.llm.workers import map_arrow

DEPTH = 3
SIMILAR = 0.7
MIN_DOCS = 10
FIELD = "<*>"
_DIGIT = re.compile(r"[0-9]")
_VARIABLE = re.compile(r"[^ ]*[0-9][^ ]*")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def parse_line(line: str, digits: bool = True) -> tuple[list[str], str, str] | None:
    """(tokens, leaf, masked line) of a line, None if it has no token. ``digits``: it may hold some."""
    tokens = line.split()
    if not tokens:
        return None
    masked = " ".join(tokens)
    if digits and _DIGIT.search(masked):
        masked = _VARIABLE.sub(FIELD, masked)
        tokens = masked.split(" ")
    return tokens, f"{len(tokens)} " + " ".join(tokens[:DEPTH]), masked


def _texts(rows: pa.RecordBatch) -> Iterator[tuple[str, bool]]:
    """Each text, null as empty, and whether it holds a digit at all (most do not)."""
    texts = pc.fill_null(rows.column("t"), "")
    return zip(texts.to_pylist(), pc.match_substring_regex(texts, "[0-9]").to_pylist())


def _line_rows(keyed: DataFrame) -> DataFrame:
    """(d, i, line, leaf, tpl) of every line with a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in slices(batch, "t"):
                owner, line, leaf, tpl = [], [], [], []
                for r, (text, digits) in enumerate(_texts(rows)):
                    for k, x in enumerate(text.split("\n")):
                        parsed = parse_line(x, digits)
                        if parsed:
                            owner.append(r)
                            line.append(k)
                            leaf.append(_hash(parsed[1]))
                            tpl.append(_hash(parsed[2]))
                owner = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column("d").take(owner), rows.column("i").take(owner), pa.array(line, pa.int32()),
                     pa.array(leaf, pa.int64()), pa.array(tpl, pa.int64())], ["d", "i", "line", "leaf", "tpl"])

    kind = keyed.schema["i"].dataType.simpleString()
    return map_arrow(keyed.select("d", "i", "t"), run, f"d bigint, i {kind}, line int, leaf bigint, tpl bigint")


def _token_rows(keyed: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, tpl, places array<long>): a hash of (leaf, place, token) for each token of the leaves' masked lines."""
    sent = keyed.sparkSession.sparkContext.broadcast(key_filter(leaves, "leaf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpack(sent.value)
        for batch in batches:
            told: set[int] = set()
            for rows, _, _ in slices(batch, "t"):
                seen: dict[int, tuple[int, list[int]]] = {}
                for text, digits in _texts(rows):
                    for x in text.split("\n"):
                        parsed = parse_line(x, digits)
                        if not parsed:
                            continue
                        leaf = _hash(parsed[1])
                        if not bits[leaf & (len(bits) - 1)]:
                            continue
                        tpl = _hash(parsed[2])
                        if tpl not in told:
                            told.add(tpl)
                            seen[tpl] = leaf, [_hash(f"{leaf} {k} {w}") for k, w in enumerate(parsed[0])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v[0] for v in seen.values()], pa.int64()), pa.array(list(seen), pa.int64()),
                     pa.array([v[1] for v in seen.values()], pa.list_(pa.int64()))], ["leaf", "tpl", "places"])

    found = map_arrow(keyed.select("t"), run, "leaf bigint, tpl bigint, places array<bigint>")
    return found.join(leaves.select("leaf"), "leaf", "left_semi").dropDuplicates(["tpl"])


def line_templates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                   min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(d, i, line, template) of every line with a token, and (template, n_docs, first) of the recurring ones.

    ``d`` is the document (a hash of id and text), ``first`` the least id that holds the template.
    """
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("d"), F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    lines = scratch.save(_line_rows(keyed), "lines")
    held = lines.select("d", "leaf", "tpl").distinct()
    by_tpl = scratch.save(held.groupBy("leaf", "tpl").agg(F.count(F.lit(1)).alias("n")), "masked")
    # Only a leaf that holds different lines, often enough, has anything to generalise.
    leaves = scratch.save(by_tpl.groupBy("leaf").agg(F.min("tpl").alias("x"), F.max("tpl").alias("y"),
                                                     F.sum("n").alias("n"))
                          .filter((F.col("x") < F.col("y")) & (F.col("n") >= min_docs)).select("leaf"), "leaves")
    tokens = scratch.save(_token_rows(keyed, leaves).join(by_tpl.select("tpl", "n"), "tpl"), "tokens")
    placed = tokens.select("leaf", "tpl", "n", F.size("places").alias("size"), F.explode("places").alias("place"))
    constant = scratch.save(placed.groupBy("place").agg(F.sum("n").alias("m"))
                            .filter(F.col("m") >= min_docs).select("place"), "constant")
    general = (placed.join(constant, "place").groupBy("leaf", "tpl", "size")
               .agg(F.count(F.lit(1)).alias("kept"), F.sum(F.xxhash64("place") % (1 << 40)).alias("sum"))
               .filter(F.col("kept") >= F.col("size") * SIMILAR)
               .select("tpl", F.xxhash64("leaf", "kept", "sum").alias("general")))
    general = scratch.save(general, "general")
    lines = scratch.save(lines.join(general, "tpl", "left")
                         .select("d", "i", "line", F.coalesce("general", "tpl").alias("template")), "templates")
    recurring = scratch.save(lines.select("d", "i", "template").distinct().groupBy("template")
                             .agg(F.count(F.lit(1)).alias("n_docs"), F.min("i").alias("first"))
                             .filter(F.col("n_docs") >= min_docs), "recurring")
    return lines, recurring


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row and column of ``docs``, its text without recurring lines, and ``n_lines`` and ``n_dropped``.

    The two counts replace columns of those names. Eager: the templates are
    written to the shared folder.
    """
    scratch = Scratch(docs.sparkSession, "line_dedup")
    lines, recurring = line_templates(docs, scratch, id_col, text_col, min_docs)
    kept_here = F.col("i").eqNullSafe(F.col("first"))
    dropped = (lines.join(recurring, "template").filter(~kept_here)
               .groupBy("d").agg(F.collect_set("line").alias("lines")))
    p = "__"  # helper columns get a prefix that no column of the documents has
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    drops = scratch.save(dropped.select(F.col("d").alias(f"{p}d"), F.col("lines").alias(f"{p}lines")), "dropped")
    # The same sort-merge join at every size: texts move once, as they would on a large table.
    joined = (docs.withColumn(f"{p}k", F.xxhash64(id_col, text_col))
              .join(drops.hint("merge"), F.col(f"{p}k") == F.col(f"{p}d"), "left"))
    gone = F.col(f"{p}lines")
    split = F.split(F.col(text_col), "\n", -1)
    left = F.transform(F.array(split), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda k: F.get(x, k)), "\n"))
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(F.get(left, F.lit(0)))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in names],
                         F.coalesce(F.size(split), F.lit(0)).cast("bigint").alias("n_lines"),
                         F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_dropped"))
