"""Operator 1: phrase counts by brute force, held-out accuracy."""

import random

import numpy as np
from pyspark.sql import functions as F

from flowspark.llm.language_id import (BLOCK, NORMAL, CrossParser, held_out, predict_language,
                                       suffix_automaton, training_texts)
from tests.conftest import SF_SMALL


def brute_phrases(training: bytes, text: bytes) -> int:
    n = 0
    for at in range(0, len(text), BLOCK):
        block, i = text[at:at + BLOCK], 0
        while i < len(block):
            j = i
            while j < len(block) and block[i:j + 1] in training:
                j += 1
            n, i = n + 1, max(j, i + 1)
    return n


def normal(text: str) -> bytes:
    return NORMAL[np.frombuffer(text.lower().encode(), np.uint8)].tobytes()


def test_automaton_reads_exactly_the_substrings():
    rnd = random.Random(2)
    for _ in range(50):
        text = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 12)))
        step = suffix_automaton(text)
        for _ in range(200):
            word = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 6)))
            state = 0
            for c in word:
                state = step[state].get(c, -1)
                if state < 0:
                    break
            assert (state >= 0) == (word in text)


def test_phrases_equal_brute_force():
    rnd = random.Random(3)
    training = {"a": ["the cat sat on the mat " * 3], "b": ["der hund saß auf der matte ü"]}
    parser = CrossParser(training)
    texts = ["", "the", "ß", "zzz", "üüx the mat"] + [
        "".join(rnd.choice("thecatder ünzß") for _ in range(rnd.choice([5, 50, 3000]))) for _ in range(30)]
    data = [normal(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    got = parser.phrases(np.frombuffer(b"".join(data), np.uint8), offsets)
    for row, x in zip(got, data):
        assert row.tolist() == [brute_phrases(b"\n".join(normal(t) for t in training[a]), x) for a in parser.langs]


def test_held_out_accuracy_and_sample_bound(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    training = training_texts(docs, ~held_out(), train_rows=16, train_chars=500)
    assert all(len(v) <= 16 and max(map(len, v)) <= 500 for v in training.values())
    rows = predict_language(docs, training).join(docs.select("doc_id", "lang", held_out().alias("h")), "doc_id").collect()
    unseen = [r for r in rows if r.h]
    assert unseen and sum(r.lang == r.lang_pred for r in unseen) >= 0.9 * len(unseen)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_rows(spark):
    rows = [(1, None, "en"), (1, "", "de"), (2, "12 !!", None), (None, "the cat and the dog", "en"),
            (3, "der hund und die katze", "de"), (3, "der hund und die katze", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    training = training_texts(df, F.lit(True))
    got = sorted(((r.doc_id, r.lang_pred, r.score > 0) for r in predict_language(df, training).collect()), key=repr)
    assert got == sorted([(1, "und", False), (1, "und", False), (2, "und", False), (None, "en", True),
                          (3, "de", True), (3, "de", True)], key=repr)
    assert training_texts(df, F.lit(False)) == {}
    assert {r.lang_pred for r in predict_language(df, {}).collect()} == {"und"}
    assert predict_language(df.limit(0), training).collect() == []
    assert {r.score for r in predict_language(df.filter("doc_id = 3"), {"de": training["de"]}).collect()} == {1.0}
