"""Operator 9 against a count of every substring."""

import collections
import hashlib
import random

import numpy as np
import pytest

from flowspark.llm import suffix_dedup as S
from tests.conftest import SF_SMALL


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[s:s + length] for _, b in data for s in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k1", "2 AS place")
    rows = S.remove_repeats(df, **kw).collect()
    assert all(r.removed_share == (r.n_removed / r.n_bytes if r.n_bytes else 0) and r.repeated == (r.n_removed > 0)
               for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=repr)


def sample(seed):
    rnd = random.Random(seed)

    def text(n):
        return "".join(rnd.choice("abcdefgh é") for _ in range(n))

    shared = [text(rnd.randint(10, 60)) for _ in range(6)]
    rows = [(i, "".join(rnd.choice(shared) if rnd.random() < .4 else text(rnd.randint(1, 30))
                        for _ in range(rnd.randint(0, 8)))) for i in range(200)]
    return rows + [(1000, None), (1001, ""), (1002, "a" * 150), (1003, "ab" * 80), (1004, rows[5][1]), (1005, rows[5][1]),
                   (1006, "x" + rows[7][1] + "y"), (5, rows[5][1]), (None, rows[9][1] + shared[0]), rows[11], rows[11]]


@pytest.mark.parametrize("kw", [
    {"length": 20, "gram": 10}, {"length": 20, "gram": 10, "group": 3, "sorted_at_once": 7},
    {"length": 24, "gram": 5, "group": 2, "sorted_at_once": 50}])
def test_overlaps_copies_and_hot_groups(spark, kw):
    rows = sample(3)
    got = run(spark, rows, **kw)
    assert got == brute(rows, kw["length"]) and sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("kw", [{"length": 20, "gram": 10}, {"length": 24, "gram": 5, "group": 2, "sorted_at_once": 50}])
def test_runs_of_short_periods(spark, kw):
    rnd = random.Random(4)

    def piece():
        unit = "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7)))
        return (unit * 40)[:rnd.randint(5, 70)] if rnd.random() < .7 else str(rnd.random())

    rows = [(i, "".join(piece() for _ in range(rnd.randint(1, 4)))) for i in range(150)]
    rows += [(200, "q" * 20), (201, "x" + "q" * 20 + "y"), (202, "z" * 24), (203, "z" * 25), (204, "uvw" * 9)]
    assert run(spark, rows, **kw) == brute(rows, kw["length"])


@pytest.mark.parametrize("unit", ["a", "ab", "x" * 50 + "y" * 49])
def test_a_run_has_no_more_anchors_than_other_text(unit):
    rnd = np.random.default_rng(4)
    text = np.concatenate([rnd.integers(97, 123, 1000), np.resize(np.frombuffer(unit.encode(), np.uint8), 40000),
                           rnd.integers(97, 123, 1000)]).astype(np.uint8)
    assert len(S.anchors_of(text, np.array([0, len(text)]), S.LENGTH, S.GRAM)[0]) < 60


def test_long_runs_and_texts_of_several_pieces(spark):
    rnd = random.Random(9)
    a, b, shared = ("".join(rnd.choice("cdefgh") for _ in range(n)) for n in (3000, 700, 500))
    rows = [(1, "ab" * 1_600_000 + "1" + a + "2" + shared), (2, b + "3" + shared), (3, "ba" * 210), (4, "a" * 399)]
    parts = {1: (3_200_500, 2, "1" + a + "2"), 2: (500, 1, b + "3"), 3: (420, 1, ""), 4: (0, 0, "a" * 399)}
    assert run(spark, rows) == [(i, len(t), *parts[i][:2], hashlib.sha256(parts[i][2].encode()).hexdigest()) for i, t in rows]


def test_documents_at_production_length(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = run(spark, rows)
    assert got == brute(rows, 400) and sum(r[2] for r in got) > 0


def test_empty_table(spark):
    assert run(spark, []) == []
