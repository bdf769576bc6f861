"""Operator 10 against a plain modified Kneser-Ney, and against labels."""

import collections
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowspark.llm import kn_quality as K
from tests.conftest import SF_SMALL


def symbols(text):
    return [int(K.SYMBOL[b]) for b in text.lower().encode()]


def plain_model(texts, order):
    counts = [None] * (order + 1)
    counts[order] = collections.Counter()
    for t in texts:
        s = [0] * (order - 1) + symbols(t)
        counts[order].update(tuple(s[k - order + 1:k + 1]) for k in range(order - 1, len(s)))
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    cut, total, left = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
    for n in range(1, order + 1):
        t = collections.Counter(counts[n].values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0
        cut[n] = [0] + [max(K.LEAST_DISCOUNT, min(k, k - (k + 1) * y * t[k + 1] / t[k])) if t[1] and t[k] else k / 2
                        for k in (1, 2, 3)]
        total[n], left[n] = collections.Counter(), collections.Counter()
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            left[n][g[:-1]] += cut[n][min(c, 3)]

    def p(g):
        if not g:
            return 1 / 256
        n, h, lower = len(g), g[:-1], p(g[1:])
        if not total[n][h]:
            return lower
        c = counts[n].get(g, 0)
        return (max(c - cut[n][min(c, 3)], 0) + left[n][h] * lower) / total[n][h]

    return p


def perplexity(p, text, order):
    s = [0] * (order - 1) + symbols(text)
    bits = -sum(math.log2(p(tuple(s[k - order + 1:k + 1]))) for k in range(order - 1, len(s)))
    return 2 ** (bits / (len(s) - order + 1))


@pytest.mark.parametrize("order", [2, 4])
def test_documents_equal_the_plain_model(spark, order):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    trusted = spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter("quality = 1").select("doc_id")
    got = {r.doc_id: r for r in K.perplexity_quality(docs, trusted, order=order, block_bytes=20_000).collect()}
    rows, ids = docs.collect(), {r.doc_id for r in trusted.collect()}
    assert set(got) == {r.doc_id for r in rows}
    for lang in ("de", "fr"):
        own = [r for r in rows if r.lang == lang]
        p = plain_model([r.text for r in own if r.doc_id in ids], order)
        for r in own[:12]:
            assert math.isclose(got[r.doc_id].perplexity, perplexity(p, r.text, order), rel_tol=1e-9)
    assert all(got[r.doc_id].kept for r in rows if r.doc_id in ids)


def test_junk_goes_and_edges_are_defined(spark):
    prose = "the quick brown fox jumps over the lazy dog and runs home again "
    rows = [(k, prose * 3 + prose[k:], "en") for k in range(20)] + [
        (50, "$$## @@!! %%^^ &&** " * 10, "en"), (51, None, "en"), (52, "", None), (53, "no model here", "xx"),
        (None, prose, "en"), (1, prose, "en"), (1, prose, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("perplexity", F.lit("x"))
    ids = spark.createDataFrame([(k,) for k in range(10)] + [(1,), (None,)], "doc_id long")
    got = K.perplexity_quality(df, ids).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[15].kept and not by_id[50].kept and by_id[None].kept
    assert (by_id[51].perplexity, by_id[51].kept, by_id[52].lang, by_id[52].kept) == (None, False, None, False)
    assert math.isclose(by_id[53].perplexity, 256) and by_id[53].kept
    assert K.perplexity_quality(df.limit(0), ids).collect() == []
    assert all(math.isclose(r.perplexity, 256) for r in K.perplexity_quality(df, ids.limit(0)).collect() if r.n_bytes)


def test_threshold_is_the_quantile_times_the_margin(spark):
    rows = [("a", float(v), v % 2 == 0) for v in range(1, 101)] + [("b", 7.0, False), ("b", None, False)]
    df = spark.createDataFrame(rows, "lang string, perplexity double, trusted boolean")
    got = {r.lang: r.threshold for r in K.thresholds(df, 0.5, 2.0).collect()}
    assert got == {"a": 100.0, "b": 14.0}


def test_the_model_has_n_grams_of_six_bytes(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").filter("lang = 'es'")
    trusted = spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter("quality = 1").select("doc_id")
    rows, ids = docs.collect(), {r.doc_id for r in trusted.collect()}
    p = plain_model([r.text for r in rows if r.doc_id in ids], 6)
    got = {r.doc_id: r.perplexity for r in K.perplexity_quality(docs, trusted).collect()}
    for r in rows[:6]:
        assert math.isclose(got[r.doc_id], perplexity(p, r.text, 6), rel_tol=1e-9)


@pytest.mark.parametrize("kind", ["long", "int"])
def test_texts_are_counted_by_id_whatever_the_bit_tables_let_pass(spark, monkeypatch, kind):
    small = K.KeyBits
    monkeypatch.setattr(K, "KeyBits", lambda keys, column: small(keys, column, most=1 << 15))
    texts = spark.range(20_000).select(F.when(F.col("id") % 50 != 3, F.col("id")).alias("i"), F.lit("x").alias("lang"),
                                       F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    ids = texts.filter("i % 2 = 0").select(F.col("i").cast(kind)).distinct()
    want = K.ngram_counts(texts.filter("i % 2 = 0"))
    got = K.trusted_counts(texts, ids)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_texts_travel_as_packs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        F.col("doc_id").alias("i"), "lang", F.col("text").alias("t"))
    packs = K._text_packs(docs)
    n = packs.agg(F.sum(F.octet_length("pack")), F.sum(F.size("ids"))).first()
    assert n[1] == docs.count() and n[0] < 0.5 * docs.agg(F.sum(F.octet_length("t"))).first()[0]


def test_counting_holds_little_beside_an_arrow_batch(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 100
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 4000, "t": [text] * 8000})
    monkeypatch.setattr(K, "CHUNK_BYTES", 2 << 20, raising=False)
    before, most = pa.total_allocated_bytes(), 0
    for _, _, _, data in K._by_language(batch, 1 << 20):  # the batch isn't copied whole
        most = max(most, pa.total_allocated_bytes() - before)
    assert most < batch.nbytes / 3
    tracemalloc.start()
    codes = K.ngram_codes(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(codes) == len(data) and peak < 12 * len(data)


def test_short_texts_and_counts_of_n_grams():
    texts = [b"", b"a", b"abc", b"", b"abcdefghij", b"zz"]
    offsets = np.cumsum([0, *map(len, texts)])
    codes = K.ngram_codes(np.frombuffer(b"".join(texts), np.uint8), offsets, 6)
    want = [int.from_bytes(t[max(0, k - 5):k + 1], "big") for t in texts for k in range(len(t))]
    assert codes.tolist() == want
    g, n = K._counted(np.array([5, 3, 5, 5, 3, 9]))
    assert (g.tolist(), n.tolist()) == ([3, 5, 9], [2, 3, 1])
    assert [x.tolist() for x in K._counted(np.zeros(0, np.int64))] == [[], []]


def test_packed_models_come_back_as_sorted_tables():
    rows = [(0, 1, 7, .5), (1, 0, 0, .25), (0, 1, 3, .125), (0, 2, 900, .75), (1, 1, 3, .5)]

    def packed(some):
        some = sorted(some)
        kind, n, g, value = (np.array(x) for x in zip(*some))
        raw = (kind.astype(np.int8).tobytes() + n.astype(np.int8).tobytes() + K._planes(np.diff(g, prepend=0))
               + K._planes(value))
        return len(some), pa.Codec("zstd").compress(raw, asbytes=True)

    m, pack = zip(packed(rows[:2]), packed(rows[2:]))
    tables = K._unpacked(pa.table({"m": m, "pack": pa.array(pack, pa.binary())}), 2).tables
    assert {k: (g.tolist(), v.tolist()) for k, (g, v) in tables.items() if len(g)} == {
        (0, 1): ([3, 7], [.125, .5]), (0, 2): ([900], [.75]), (1, 0): ([0], [.25]), (1, 1): ([3], [.5])}
    assert not len(K._unpacked(pa.table({"m": pa.array([], pa.int64()), "pack": pa.array([], pa.binary())}), 2).tables[0, 1][0])
