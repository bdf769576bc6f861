"""Operator 5 against a dictionary of windows."""

import collections
import hashlib
import random

import pytest

from flowspark.llm import decontamination as D
from flowspark.llm.tables import key_filter
from tests.conftest import SF_SMALL


def brute(docs, items, window=13):
    by_size = collections.defaultdict(lambda: collections.defaultdict(set))
    for i, t in items:
        w = D.words_of(t)
        if w and i is not None:
            k = min(window, len(w))
            for s in range(len(w) - k + 1):
                by_size[k][tuple(w[s:s + k])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = D.words_of(t), set(), set()
        for k, grams in by_size.items():
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in grams:
                    hit.update(range(s, s + k))
                    found |= grams[tuple(w[s:s + k])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def run(spark, docs, items, window=13):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS item_id")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in D.decontaminate(d, b, window=window).select(COLS).collect()), key=repr)


def test_planted_passages(spark):
    rnd = random.Random(5)
    words = ["the", "of", "a", "in"] + [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 20])))) for k in range(12)]
    items += [(3, "another text of item three w1 w2"), (None, "w1 w2"), (50, ""), (51, None), (52, "The, OF! a")]
    docs = []
    for i in range(120):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))]
        if rnd.random() < .5:
            parts.append(rnd.choice(items)[1] or "")
        docs.append((i, rnd.choice([" ", "\n", ", "]).join(parts).replace("w1", "W1")))
    docs += [(200, None), (201, ""), (5, docs[5][1]), docs[7], docs[7], (None, docs[9][1])]
    for window in (13, 4):
        assert run(spark, docs, items, window) == brute(docs, items, window)


def test_benchmark_texts_that_differ_in_case_and_punctuation_only(spark):
    passage = [f"w{k}" for k in range(20)]
    items = [(7, "The, OF! a"), (7, "the of a"), (8, " ".join(passage)), (8, ", ".join(passage).upper()), (8, " ".join(passage))]
    docs = [(1, "x the of a y"), (2, "z " + " ".join(passage)), (3, "the a of " + " ".join(passage[::-1]))]
    got = run(spark, docs, items)
    assert got == brute(docs, items) and [r[2] for r in got] == [3, 20, 0]


def test_documents_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = run(spark, docs, items)
    assert got == brute(docs, items) and any(r[-1] for r in got)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert [r[2] for r in run(spark, [(1, "a b")], [])] == [0]


@pytest.mark.parametrize("slop,found", [(0, {1}), (3, {1, 2})])
def test_proximity_allows_words_between(spark, slop, found):
    docs = spark.createDataFrame([(1, "x alpha beta gamma y"), (2, "alpha and then gamma beta"), (3, "alpha only")],
                                 "doc_id long, text string")
    items = D.benchmark_items(spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string"))
    terms = items.selectExpr("explode(terms) AS term")
    anchors = D.choose_anchors(items, D.term_counts(docs, key_filter(terms, "term")), window=3, anchors=3)
    index = D.postings(docs, key_filter(anchors, "term"))
    assert {r.i for r in D.proximity_matches(index, anchors, slop).collect()} == found
