"""Operator 5: benchmark decontamination by a distributed positional inverted index.

1. Term counts over all documents, for the terms the benchmark asks for.
2. Every window of 13 item words (a shorter item is one window) is represented
   by its two rarest terms, its anchors; an item's anchors are those of its windows.
3. The positional index is stored in the shared folder: for each document and
   anchor term, the positions it stands at (and each document's word count).
4. Posting lists are intersected after subtracting the anchor's offset in the
   item: where two anchors agree on the difference, the item may stand there.
5. The words of those places are compared; runs of 13 equal words (a whole
   shorter item) are occurrences, and the words inside are hit.

``proximity_matches`` intersects the same lists with a tolerance on the
difference: anchors in the item's order of distance, at most ``slop`` words off.

Terms travel as 64-bit hashes; step 5 compares words, so results are exact. The
only things sent to all executors are two bit tables of 2**22 bits, a fixed
size whatever the benchmark's: they say which hashes can be asked for, and the
joins that follow drop what passes by chance. No list is gathered per term: the
lists are intersected by a join on the term and a count per (document, item,
difference), so a term or passage that a third of the documents hold is spread.

Defined results: null text has no words; a document without words is clean;
benchmark rows with a null id or no words are no items; rows with the same
item id are one item; repeated documents each give their own row; ids may be
null; only id and text columns are read, so others may have any name; an empty
document table gives an empty table, an empty benchmark gives no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.tables import key_filter, slots, unpack
from flowspark.llm.textbytes import LOWER, byte_class, prefix_hashes, slices, span_hashes, word_bounds
from flowspark.llm.workers import map_arrow
from flowspark.session import work_dir

WINDOW = 13
ANCHORS = 2       # rarest terms that stand for a window
CONTAMINATED = 20  # hit words times this reach the document's words

#: Bytes of words: digits, letters, and all of every other character.
MEMBER = byte_class(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = LOWER.tobytes()


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = word_bounds(data, offsets, MEMBER)
    return span_hashes(prefix_hashes(LOWER[data]), starts, ends).view(np.int64), bounds


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, row, words array<string>, terms array<long>) of every benchmark row with an id and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, data in slices(batch, "t"):
                terms, bounds = _terms(data, offsets)
                lists = pa.LargeListArray.from_arrays(bounds, terms).cast(pa.list_(pa.int64()))
                words = [[w.decode() for w in words_of(t)] for t in rows.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("i"), pa.array(words, pa.list_(pa.string())), lists],
                                                 ["item", "words", "terms"])

    kind = benchmark.schema[id_col].dataType.simpleString()
    rows = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    items = map_arrow(rows.distinct(), run, f"item {kind}, words array<string>, terms array<bigint>")
    # Texts that differ in case, punctuation or blanks alone are one row.
    return (items.filter(F.size("words") > 0).dropDuplicates(["item", "words"])
            .withColumn("row", F.xxhash64("item", "words")))


def term_counts(docs: DataFrame, wanted: bytes, text_col: str = "text") -> DataFrame:
    """(term, n): occurrences in all documents of the terms that pass the bit table ``wanted``."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpack(sent.value)
        for batch in batches:
            for _, offsets, data in slices(batch, "t"):
                terms, _ = _terms(data, offsets)
                term, n = np.unique(terms[bits[slots(terms)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], ["term", "n"])

    part = map_arrow(docs.select(F.col(text_col).alias("t")), run, "term bigint, n bigint")
    return part.groupBy("term").agg(F.sum("n").alias("n"))


def choose_anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> DataFrame:
    """(row, term, off, need): the rarest terms of each window that can occur; ``need`` of them must agree."""
    asked = items.select("row", F.posexplode("terms").alias("off", "term"))
    counted = (asked.join(counts, "term", "left")
               .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("off", "term", "n"))).alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                k = min(window, len(at))
                chosen: set[int] = set()
                for s in range(len(at) - k + 1):
                    if all(w["n"] for w in at[s:s + k]):
                        chosen.update(sorted(range(s, s + k), key=lambda j: (at[j]["n"], j))[:anchors])
                out += [(row, at[j]["term"], at[j]["off"], min(anchors, k)) for j in sorted(chosen)]
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                ["row", "term", "off", "need"])

    return map_arrow(counted, run, "row bigint, term bigint, off int, need int")


def postings(docs: DataFrame, wanted: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index: (i, h, term, positions, n_words).

    One row for each document and term of the bit table, and one a document with
    a null term that holds its word count. (i, h) is the document: its id and
    its text's hash.
    """
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpack(sent.value)
        for batch in batches:
            for rows, offsets, data in slices(batch, "t"):
                terms, bounds = _terms(data, offsets)
                at = np.flatnonzero(bits[slots(terms)])
                text_of = np.searchsorted(bounds, at, "right") - 1
                order = np.lexsort((at, terms[at], text_of))
                at, text_of = at[order], text_of[order]
                first = np.flatnonzero(np.concatenate(
                    [[True], (terms[at][1:] != terms[at][:-1]) | (text_of[1:] != text_of[:-1])])) if len(at) else at
                n = len(bounds) - 1
                owner = np.concatenate([np.arange(n), text_of[first]])
                ends = np.concatenate([np.zeros(n + 1, np.int64), np.append(first, len(at))[1:]])
                lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array((at - bounds[text_of]).astype(np.int32)))
                blank = np.arange(len(owner)) < n
                yield pa.RecordBatch.from_arrays([
                    rows.column("i").take(pa.array(owner)), rows.column("h").take(pa.array(owner)),
                    pa.array(np.concatenate([np.zeros(n, np.int64), terms[at][first]]), mask=blank), lists,
                    pa.array(np.concatenate([np.diff(bounds), np.zeros(len(first), np.int64)]), mask=~blank)],
                    ["i", "h", "term", "positions", "n_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(_keyed(docs, id_col, text_col), run,
                     f"i {kind}, h bigint, term bigint, positions array<int>, n_words bigint")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))


def _adjusted(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(i, h, row, need, off, diff): postings less the anchor's offset in its item."""
    lists = index.filter(F.col("term").isNotNull()).select("i", "h", "term", "positions").dropDuplicates(["i", "h", "term"])
    return (lists.join(anchors, "term")
            .select("i", "h", "row", "need", "off", F.explode("positions").alias("pos"))
            .withColumn("diff", F.col("pos") - F.col("off")).drop("pos"))


def phrase_candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(i, h, row, diff) where enough anchors of an item agree on its place."""
    return (_adjusted(index, anchors).groupBy("i", "h", "row", "diff", "need").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= F.col("need")).select("i", "h", "row", "diff"))


def proximity_matches(index: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """(i, h, row, n_anchors): places where anchors of an item stand at most ``slop`` words off their distance.

    The window's partition is one document and one item.
    """
    near = (Window.partitionBy("i", "h", "row").orderBy("diff").rangeBetween(0, slop))
    return (_adjusted(index, anchors).withColumn("n", F.size(F.collect_set("off").over(near)))
            .filter(F.col("n") >= F.col("need")).groupBy("i", "h", "row").agg(F.max("n").alias("n_anchors")))


def _hits(words: list[bytes], item: list[bytes], diff: int, window: int) -> list[tuple[int, int]]:
    """Ranges of the document's words that equal at least a window of the item's, laid at ``diff``."""
    k = min(window, len(item))
    out, begin = [], None
    for j in range(max(0, -diff), min(len(item), len(words) - diff) + 1):
        same = j < len(item) and diff + j < len(words) and words[diff + j] == item[j]
        if same and begin is None:
            begin = j
        elif not same and begin is not None:
            if j - begin >= k:
                out.append((diff + begin, diff + j))
            begin = None
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated), one row a document.

    ``text_hash`` is Spark's xxhash64 of the text. Eager: the index is written
    to the shared folder (``spark.checkpoint.dir``) before the result is planned.
    """
    spark = docs.sparkSession
    items_at = work_dir(spark, "decontamination", "items")
    benchmark_items(benchmark, item_id_col, item_text_col).write.parquet(items_at)
    items = spark.read.parquet(items_at)
    asked = key_filter(items.select(F.explode("terms").alias("term")), "term")
    anchors_at = work_dir(spark, "decontamination", "anchors")
    choose_anchors(items, term_counts(docs, asked, text_col), window).write.parquet(anchors_at)
    anchors = spark.read.parquet(anchors_at)
    index_at = work_dir(spark, "decontamination", "postings")
    postings(docs, key_filter(anchors, "term"), id_col, text_col).write.parquet(index_at)
    index = spark.read.parquet(index_at)

    # an item's words go to a document once, however often the document repeats it
    places = (phrase_candidates(index, anchors).groupBy("i", "h", "row").agg(F.collect_list("diff").alias("diffs"))
              .join(items.select("row", "item", "words"), "row")
              .groupBy(F.col("i").alias("pi"), F.col("h").alias("ph"))
              .agg(F.collect_list(F.struct(F.col("item").cast("string").alias("item"), "words", "diffs"))
                   .alias("places")))
    texts = _keyed(docs, id_col, text_col)
    placed = texts.join(places, texts.i.eqNullSafe(places.pi) & (texts.h == places.ph))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at in range(0, b.num_rows, 64):
                for text, places in zip(b.column("t").slice(at, 64).to_pylist(),
                                        b.column("places").slice(at, 64).to_pylist()):
                    words = words_of(text)
                    hit, found = np.zeros(len(words), bool), set()
                    for p in places:
                        item = [w.encode() for w in p["words"]]
                        for s, e in (x for diff in p["diffs"] for x in _hits(words, item, diff, window)):
                            hit[s:e] = True
                            found.add(p["item"])
                    out.append((int(hit.sum()), len(found),
                                hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
            columns = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [b.column("i"), b.column("h"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.string())], ["fi", "fh", "n_hit", "n_items", "items_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = map_arrow(placed.select("i", "h", "t", "places"), run,
                      f"fi {kind}, fh bigint, n_hit bigint, n_items bigint, items_sha256 string"
                      ).dropDuplicates(["fi", "fh"])
    every = index.filter(F.col("term").isNull()).select("i", "h", "n_words")
    none = hashlib.sha256(b"").hexdigest()
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return (every.join(found, every.i.eqNullSafe(found.fi) & (every.h == found.fh), "left")
            .select(F.col("i").alias(id_col), F.col("h").alias("text_hash"), "n_words", n_hit.alias("n_hit"),
                    F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
                    F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"),
                    ((n_hit > 0) & (n_hit * CONTAMINATED >= F.col("n_words"))).alias("contaminated")))
