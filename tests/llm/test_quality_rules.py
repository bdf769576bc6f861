"""Operator 4: base figures by brute force, fertility by the library, verdicts by label."""

import collections
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from flowspark.llm.quality_rules import BANDS, Band, Vocabulary, quality_rules
from tests.conftest import SF_SMALL

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if counts[tuple(words[i:i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(inside), failed)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judged(df, **kw):
    return quality_rules(df, RANKS, public_tokenizers.PATTERN, **kw)


def test_documents_and_labels(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: r for r in judged(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {i: tuple(r[c] for c in BASE) for i, r in got.items()} == {i: brute(t) for i, t in texts.items()}
    labels = [r for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()
              if not got[r.doc_id].base_failed]
    good, bad = [r for r in labels if r.quality == 1], [r for r in labels if r.quality == 0]
    assert all(got[r.doc_id].kept for r in good)
    assert sum(not got[r.doc_id].kept for r in bad) >= 0.7 * len(bad)


def test_vocabulary_equals_the_library():
    with open(RANKS, "rb") as f:
        ranks = f.read()
    own = Vocabulary(ranks, public_tokenizers.PATTERN)
    for text in ["", "Hello  world\n\n x", "a" * 500, "Ünïcode 漢字 😀 \x00", "it's   1234567 ...\t\n "]:
        assert np.frombuffer(own.ids(text), np.uint32).tolist() == own.encoding.encode_ordinary(text)
    assert isinstance(own.encoding, tiktoken.Encoding)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a b c d e f g h " * 9, "x\n\nx\n x\nx", "é" * 40,
                                  "one two three four five six seven eight nine one two three four five six seven eight"])
def test_edge_texts(spark, text):
    df = spark.createDataFrame([(1, text, None), (1, text, "xx")], "doc_id long, text string, lang string")
    for r in judged(df).collect():
        assert tuple(r[c] for c in BASE) == brute(text or "")
        assert not (r.base_failed and r.kept)


def test_bands_by_language_then_script_and_carried_columns(spark):
    words = " ".join(f"слово{chr(1072 + k)}" for k in range(30))
    latin = " ".join(f"word{chr(97 + k % 26)}{k}" for k in range(30))
    rows = [(1, words, "ru"), (2, latin, "en"), (3, latin, None), (None, latin, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    bands = {**BANDS, "Cyrillic": Band(99, 100, 1, 0, 0, 0), "en": Band(0, 100, 1, 0, 0, 0), "Latin": Band(99, 100, 1)}
    got = {(r.doc_id, r.script): (r.kept, r.lang) for r in judged(df, bands=bands, carry=["lang"]).collect()}
    assert got == {(1, "Cyrillic"): (False, "ru"), (2, "Latin"): (True, "en"), (3, "Latin"): (False, None),
                   (None, "Latin"): (True, "en")}
    assert judged(df.limit(0)).collect() == []
