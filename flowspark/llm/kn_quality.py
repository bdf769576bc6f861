"""Operator 10: quality by perplexity under interpolated modified Kneser-Ney models.

One model of byte n-grams (order 6, a word of the usual length and its blank) per
language, counted over all trusted text:

1. N-gram counts: each task counts its texts' n-grams, partial counts are summed by
   n-gram. Lower orders count in how many n-grams each suffix continues. A text is
   counted where it is read if its id passes the bit table of the trusted ids and not
   the one of the untrusted ids that pass that by chance; only the few texts that pass
   both are shuffled, to a join with the ids that decides.
2. Discounts follow from the counts of counts; context totals and the
   probabilities of the next lower order are joined to the counts by (language, n-gram), so
   every step is spread over shards of n-grams.
3. The model is a table: probability of each n-gram, back-off weight of each context.
   Texts travel as packs, compressed symbols of one language, dealt into
   blocks of about ``BLOCK_BYTES`` of text; the model's rows, packed as well, go to
   each block of their language, and a block is scored pack by pack with its
   model beside it. Nothing is sent to all executors or through the driver but bit tables.
4. A document is kept if its perplexity (per byte) is at most the language's
   threshold: a quantile over the trusted documents' perplexities, from exact
   counts of values rounded up to a thousandth, times ``MARGIN``.

Text is lower-cased; blanks and control bytes are one symbol, digits another. The
first bytes see a begin symbol. A language is what the language column says, null
being one of its own.

Defined results: null or empty text has no perplexity and is not kept; a
language without trusted text is scored uniformly (256) and judged by its own
documents; texts are scored whole; repeated documents each give their own row,
and repeated labels count once; only id, text and language columns are read, so
others may have any name; an empty table gives an empty table; a value at the
threshold is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.tables import KeyBits, Scratch
from flowspark.llm.textbytes import LOWER, slices
from flowspark.llm.workers import import_path, map_arrow

ORDER = 6                 # the highest whose n-grams fit a signed 64-bit number with room for a shift
PACK_BYTES = 1 << 19      # text in a pack
PACK_LEVEL = 6            # of the packs' compression
QUANTILE = 0.999
MARGIN = 1.5              # trusted text was counted in the model, so it scores better than unseen text as good
LEAST_DISCOUNT = 0.1      # keeps every back-off weight positive
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 8 << 20     # text of an Arrow batch that is copied at once
COUNT_BYTES = 1 << 20     # text whose n-grams are counted at once


def _symbol_table() -> np.ndarray:
    table = LOWER.copy()
    table[:33] = 32
    table[127] = 32
    table[48:58] = 48
    return table


SYMBOL = _symbol_table()


def ngram_codes(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Each byte's n-gram as a number, a byte a symbol, 0 before the text."""
    symbols = SYMBOL[data]
    places = np.zeros((len(symbols), 8), np.uint8)  # of each number, its last byte first
    for k in range(order):
        places[k:, k] = symbols[:-k or None]
    for place in range(order - 1):
        first = offsets[:-1] + place
        places[first[first < offsets[1:]], place + 1:] = 0
    return places.view("<i8").ravel()


def _lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns = [pc.utf8_lower(pc.fill_null(batch.column("t"), "")) if n == "t" else batch.column(n)
               for n in batch.schema.names]
    return pa.RecordBatch.from_arrays(columns, batch.schema.names)


def _by_language(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(lang, rows, offsets, bytes) of the lower-cased texts, about ``limit`` bytes of one language at once.

    Only ``CHUNK_BYTES`` of the batch are put in order at once, so that it isn't copied whole.
    """
    for chunk, _, _ in slices(batch, "t", CHUNK_BYTES):
        rows = chunk.take(pc.sort_indices(chunk.column("lang")))
        code = pc.dictionary_encode(rows.column("lang")).indices.to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]]).tolist()
        for i, j in zip(bounds[:-1], bounds[1:]):
            for part, _, _ in slices(rows.slice(i, j - i), "t", limit):
                for part, offsets, data in slices(_lowered(part), "t", 2 * limit):
                    yield part.column("lang")[0].as_py(), part, offsets, data


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers and how often each stands; ``codes`` are sorted in place."""
    codes.sort()
    first = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=first[1:])
    at = np.flatnonzero(first)
    return codes[at], np.diff(at, append=len(codes))


def _partial_counts(texts: DataFrame, order: int, among: KeyBits | None = None, but: KeyBits | None = None) -> DataFrame:
    """(lang, g, c) of each task's texts whose key k passes ``among`` and not ``but``."""

    def run(batches):
        for batch in batches:
            for chunk, _, _ in slices(batch, "t", CHUNK_BYTES):
                if among is not None:
                    k = chunk.column("k").to_numpy()
                    chunk = chunk.filter(pa.array(among.test(k) & ~but.test(k)))
                for lang, _, offsets, data in _by_language(chunk, COUNT_BYTES):
                    g, n = _counted(ngram_codes(data, offsets, order))
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(lang, len(g)), pa.array(g), pa.array(n.astype(np.int64))], ["lang", "g", "c"])

    columns = ["lang", "t"] if among is None else ["lang", "t", "k"]
    return map_arrow(texts.select(*columns), run, "lang string, g bigint, c bigint")


def _summed(part: DataFrame) -> DataFrame:
    return part.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def ngram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, g, c): counts of the highest order's n-grams in the columns (lang, t)."""
    return _summed(_partial_counts(texts, order))


def trusted_counts(texts: DataFrame, ids: DataFrame, order: int = ORDER) -> DataFrame:
    """``ngram_counts`` of the texts (i, lang, t) whose id is among ``ids`` (i, distinct, not null)."""
    if texts.schema["i"].dataType != ids.schema["i"].dataType:
        return ngram_counts(texts.join(ids, "i", "left_semi"), order)
    key = F.xxhash64("i")
    texts = texts.filter(F.col("i").isNotNull()).withColumn("k", key)
    among = KeyBits(ids.select(key.alias("k")), "k")

    def passing(batches):
        for batch in batches:
            yield batch.filter(pa.array(among.test(batch.column("k").to_numpy())))

    kind = texts.schema["i"].dataType.simpleString()
    chance = map_arrow(texts.select("i", "k"), passing, f"i {kind}, k bigint").join(ids, "i", "left_anti")
    but = KeyBits(chance.select("k").distinct(), "k")

    def doubtful(batches):
        for batch in batches:
            k = batch.column("k").to_numpy()
            yield batch.filter(pa.array(among.test(k) & but.test(k)))

    rest = map_arrow(texts.select("i", "lang", "t", "k"), doubtful, f"i {kind}, lang string, t string, k bigint")
    return _summed(_partial_counts(texts, order, among, but).union(
        _partial_counts(rest.join(ids, "i", "left_semi"), order)))


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): the modified discounts of one order, clipped to what they discount."""
    t = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double").alias(f"t{k}") for k in range(1, 5)]
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))

    def d(k: int) -> Column:
        whole = F.lit(k) - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}")
        known = (F.col("t1") > 0) & (F.col(f"t{k}") > 0)
        return F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(k)), F.when(known, whole).otherwise(k / 2))).alias(f"d{k}")

    return counts.groupBy("lang").agg(*t).select("lang", d(1), d(2), d(3))


def kneser_ney(counts: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """The model (lang, kind, n, g, value): kind 0 is the probability of the n-gram g of order n, kind 1
    the back-off weight of g as a context of n symbols."""
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1))
        levels[n] = scratch.save(levels[n + 1].groupBy("lang", suffix.alias("g")).agg(F.count(F.lit(1)).alias("c")),
                                 f"counts{n}")
    lower = counts.select("lang").distinct().withColumn("g", F.lit(0).cast("bigint")).withColumn("p", F.lit(1 / 256))
    model = None
    for n in range(1, order + 1):
        context = F.shiftright("g", 8) if n > 1 else F.lit(0).cast("bigint")
        rows = (levels[n].withColumn("h", context)
                .withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))))
        ctx = (rows.groupBy("lang", "h").agg(
            F.sum("c").alias("total"), *[F.sum(F.when(test, 1).otherwise(0)).alias(f"n{k}") for k, test in (
                (1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") > 2))])
            .join(_discounts(levels[n]), "lang")
            .select("lang", "h", "total", "d1", "d2", "d3",
                    ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3"))
                     / F.col("total")).alias("gamma")))
        ctx = scratch.save(ctx, f"contexts{n}")
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("total")
        probs = (rows.join(ctx, ["lang", "h"]).join(lower.select("lang", F.col("g").alias("s"), "p"), ["lang", "s"])
                 .select("lang", "g", (own + F.col("gamma") * F.col("p")).alias("p")))
        lower = scratch.save(probs, f"probs{n}")
        part = (lower.select("lang", F.lit(0).alias("kind"), F.lit(n).alias("n"), "g", F.col("p").alias("value"))
                .union(ctx.select("lang", F.lit(1), F.lit(n - 1), "h", "gamma")))
        model = part if model is None else model.union(part)
    return model


class Model:
    """One language's rows as sorted arrays."""

    def __init__(self, parts: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]], order: int):
        """``parts``: pieces (g, value) of the rows by (kind, n); they are taken out as their table is made."""
        self.order, self.tables = order, {}
        for k in (0, 1):
            for m in range(order + 1):
                pieces = parts.pop((k, m), [(np.zeros(0, np.int64), np.zeros(0))])
                g, value = (np.concatenate(x) for x in zip(*pieces))
                at = np.argsort(g, kind="stable")
                self.tables[k, m] = g[at], value[at]

    def _find(self, kind: int, n: int, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables[kind, n]
        if not len(keys):
            return np.zeros(len(g), bool), np.ones(len(g))
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        return keys[at] == g, values[at]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        out, weight = np.empty(len(codes)), np.ones(len(codes))
        rest, n = np.arange(len(codes)), self.order
        while n and len(rest):
            g = codes[rest] & ((1 << 8 * n) - 1)
            known, p = self._find(0, n, g)
            out[rest[known]] = weight[rest[known]] * p[known]
            rest, g = rest[~known], g[~known]
            seen, gamma = self._find(1, n - 1, g >> 8 if n > 1 else np.zeros_like(g))
            weight[rest[seen]] *= gamma[seen]
            n -= 1
        out[rest] = weight[rest] / 256
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits each text costs."""
        every, at = np.unique(ngram_codes(data, offsets, self.order), return_inverse=True)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        return np.bincount(text, -np.log2(self.probabilities(every))[at], len(offsets) - 1)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(kind).ravel()


def _model_packs(model: DataFrame) -> DataFrame:
    """(lang, m, pack): the model's rows, m in a pack."""

    def run(batches):
        zstd = pa.Codec("zstd")
        for batch in batches:
            langs = pc.dictionary_encode(batch.column("lang"))
            of = langs.indices.to_numpy()
            kind, n, g, value = (batch.column(c).to_numpy() for c in ("kind", "n", "g", "value"))
            for x, lang in enumerate(langs.dictionary.to_pylist()):
                at = np.flatnonzero(of == x)
                at = at[np.lexsort((g[at], n[at], kind[at]))]
                pack = zstd.compress(kind[at].astype(np.int8).tobytes() + n[at].astype(np.int8).tobytes()
                                     + _planes(np.diff(g[at], prepend=0)) + _planes(value[at]), asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([len(at)]), pa.array([pack], pa.binary())],
                                                 ["lang", "m", "pack"])

    return map_arrow(model.select("lang", "kind", "n", "g", "value"), run, "lang string, m bigint, pack binary")


def _unpacked(packs: pa.Table, order: int) -> Model:
    zstd, parts = pa.Codec("zstd"), {}
    for m, pack in zip(packs.column("m").to_pylist(), packs.column("pack")):
        raw = zstd.decompress(pack.as_buffer(), 18 * m, asbytes=True)
        kind, n = np.frombuffer(raw, np.int8, m), np.frombuffer(raw, np.int8, m, m)
        g, value = np.cumsum(_from_planes(raw[2 * m:10 * m], np.int64)), _from_planes(raw[10 * m:], np.float64)
        cuts = np.flatnonzero((np.diff(kind) != 0) | (np.diff(n) != 0)) + 1  # a pack is sorted by kind and n
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), m]):
            parts.setdefault((int(kind[i]), int(n[i])), []).append((g[i:j].copy(), value[i:j].copy()))
    return Model(parts, order)


def _text_packs(docs: DataFrame) -> DataFrame:
    """(lang, ids, sizes, pack): texts of one language as compressed symbols, with their ids and bytes."""

    def run(batches):
        zstd = pa.Codec("zstd", compression_level=PACK_LEVEL)
        for batch in batches:
            for lang, rows, offsets, data in _by_language(batch, PACK_BYTES):
                whole = pa.array([0, rows.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.ListArray.from_arrays(whole, rows.column("i")),
                     pa.ListArray.from_arrays(whole, pa.array(np.diff(offsets))),
                     pa.array([zstd.compress(SYMBOL[data].tobytes(), asbytes=True)], pa.binary())],
                    ["lang", "ids", "sizes", "pack"])

    kind = docs.schema["i"].dataType.simpleString()
    return map_arrow(docs.select("i", "lang", "t"), run,
                     f"lang string, ids array<{kind}>, sizes array<bigint>, pack binary")


def _perplexities(docs: DataFrame, packs: DataFrame, blocks: dict[str, int], order: int) -> DataFrame:
    """(i, lang, n_bytes, perplexity) of the columns (i, lang, t), under the model in ``_model_packs``."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_arrays([pa.array([], left.schema.field("ids").type.value_type), pa.array([], pa.string()),
                                           pa.array([], pa.int64()), pa.array([], pa.float64())], names)]
        own, zstd = _unpacked(right, order), pa.Codec("zstd")
        for batch in left.to_batches():
            for x in range(batch.num_rows):
                n = batch.column("sizes")[x].values.to_numpy()
                offsets = np.concatenate([[0], np.cumsum(n)])
                data = np.frombuffer(zstd.decompress(batch.column("pack")[x].as_buffer(), int(offsets[-1])), np.uint8)
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.exp2(own.bits(data, offsets) / n)
                out.append(pa.RecordBatch.from_arrays(
                    [batch.column("ids")[x].values, pa.repeat(batch.column("lang")[x], len(n)), pa.array(n),
                     pa.array(value, mask=n == 0)], names))
        return pa.Table.from_batches(out)

    names = ["i", "lang", "n_bytes", "perplexity"]
    import_path(docs.sparkSession)
    pairs = [x for k, v in blocks.items() for x in (F.lit(k), F.lit(v))]
    many = F.element_at(F.create_map(*pairs), F.col("lang")) if pairs else F.lit(1)
    dealt = _text_packs(docs).withColumn("block", F.pmod(F.xxhash64("ids", "pack"), many))
    sent = packs.withColumn("block", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.coalesce(many, F.lit(1)).cast("bigint") - 1)))
    kind = docs.schema["i"].dataType.simpleString()
    return (dealt.groupBy("lang", "block").cogroup(sent.groupBy("lang", "block"))
            .applyInArrow(score, f"i {kind}, lang string, n_bytes bigint, perplexity double"))


def thresholds(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang, threshold): ``margin`` times the quantile of each language's trusted perplexities, of all if it has none trusted."""
    counts = (scored.filter(F.col("perplexity").isNotNull())
              .groupBy("lang", F.ceil(F.col("perplexity") * 1000).alias("v"))
              .agg(F.count(F.lit(1)).alias("every"), F.sum(F.col("trusted").cast("long")).alias("ours")))
    by_lang = Window.partitionBy("lang")  # rows are distinct rounded perplexities, at most 256,000 a language
    below = by_lang.orderBy("v")
    use = F.when(F.sum("ours").over(by_lang) > 0, F.col("ours")).otherwise(F.col("every"))
    return (counts.withColumn("n", use)
            .withColumn("upto", F.sum("n").over(below)).withColumn("all", F.sum("n").over(by_lang))
            .filter(F.col("upto") >= F.col("all") * quantile)
            .groupBy("lang").agg((F.min("v") / 1000 * margin).alias("threshold")))


def perplexity_quality(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, lang, n_bytes, perplexity, threshold, trusted, kept), one row a document.

    ``trusted_ids`` has the column ``id_col``. Eager: counts and the model are
    written to the shared folder.
    """
    scratch = Scratch(docs.sparkSession, "kn_quality")
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(lang_col, F.lit("")).alias("lang"),
                        F.col(text_col).alias("t"))
    ids = scratch.save(trusted_ids.select(F.col(id_col).alias("i")).filter(F.col("i").isNotNull()).distinct(), "ids")
    counts = scratch.save(trusted_counts(texts, ids, order), f"counts{order}")
    model = scratch.save(_model_packs(kneser_ney(counts, scratch, order)), "model")
    sizes = texts.groupBy("lang").agg(F.sum(F.octet_length("t")).alias("n")).collect()  # a row a language
    blocks = {r.lang: max(1, math.ceil((r.n or 0) / block_bytes)) for r in sizes}
    scored = scratch.save(_perplexities(texts, model, blocks, order), "scored")
    flagged = scored.join(ids.withColumn("trusted", F.lit(True)), "i", "left").withColumn(
        "trusted", F.coalesce("trusted", F.lit(False)))
    limits = thresholds(flagged, quantile).collect()  # a row a language
    pairs = [x for r in limits for x in (F.lit(r.lang), F.lit(r.threshold))]
    limit = F.element_at(F.create_map(*pairs), F.col("lang")) if pairs else F.lit(None).cast("double")
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    lang = F.when(F.col("lang") != "", F.col("lang"))
    return flagged.withColumn("threshold", limit).select(
        F.col("i").alias(id_col), lang.alias("lang"), "n_bytes", "perplexity", "threshold", "trusted",
        keep.alias("kept"))
