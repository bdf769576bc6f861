"""Operator 13 against every anchor's scores with all rows."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from flowspark.llm import hard_negatives as hn
from flowspark.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<double>, label int"
COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    """Rows as distinct whole-number vectors; ids that are null come last."""
    seen = {}
    for i, vec, label in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        whole = tuple(math.floor(256 * x) for x in vec)
        if any(abs(x) >= math.sqrt(2 ** 62 / len(whole)) for x in whole):
            continue
        seen[i, label, tuple(vec)] = (i, label, whole)
    rows = list(seen.values())
    out = []
    for a, (i, label, vec) in enumerate(rows):
        if i is None or i % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), j is None, j or 0, j, other)
                        for b, (j, other, v) in enumerate(rows) if b != a and len(v) == len(vec))
        for s, _, _, p, other in [r for r in scored if r[4] == label][:5]:
            hard = [r for r in scored if r[4] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(i, p, k + 1, r[3], -s, -r[0]) for k, r in enumerate(hard)]
    return sorted(out, key=repr)


def mined(df, **options):
    return sorted((tuple(r[c] for c in COLS) for r in hn.hard_negatives(df, **options).collect()), key=repr)


def relabelled(rows):
    return [(i, v, None if c is None else (c + 1) % 10 if i is not None and i % 7 == 0 else c) for i, v, c in rows]


def test_embeddings(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = relabelled([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    got = sorted((tuple(r[c] for c in COLS) for r in QUERIES["op13_hard_negatives"](spark, SF_SMALL).collect()), key=repr)
    assert got == brute(rows) and got


def clusters(rnd, n, dim, spread):
    heart = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(k, [c + rnd.gauss(0, spread) for c in heart[k % 6]], rnd.randrange(3)) for k in range(n)]


@pytest.mark.parametrize("options", [{"part": 60, "page": 8, "block": 2}, {"part": 300, "page": 16}])
def test_many_parts_pages_and_blocks(spark, options):
    rows = clusters(random.Random(3), 1200, 6, 0.2)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert mined(df, **options) == brute(rows) != []


def test_ties_copies_and_rows_left_out(spark):
    rnd = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.5, 0.25], k % 3) for k in range(400)]  # one vector, a third of all rows and more
    rows += [(1000 + k, [rnd.choice([0.9, 1.0, 1.1]) for _ in range(3)], k % 3) for k in range(300)]
    rows += [(2000, None, 1), (2100, [1.0, None, 1.0], 1), (2200, [nan, 1.0, 1.0], 1), (2300, [1.0, inf, 1.0], 1),
             (2400, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 2), (2500, [1e30, 1.0, 1.0], 1),
             (2600, [1.0, 2.0], 1), (2601, [1.0, 2.0], 1), (2602, [1.0, 1.9], 2), (2700, [], 1), (2701, [], 1), (2702, [], 0),
             (2800, [-1.0, -1.0, -1.0], 1), (2900, [0.0, -0.0, 0.0], 2), (3000, [1e6, 1e6, 1e6], 1), (3001, [9e5, 1e6, 1e6], 2),
             (3002, [1e6, 1e6, 999999.0], 1)]
    rows += [(3100, [1.0, 1.0, 1.1], 1)] * 2 + [(3100, [1.0, 1.0, 1.2], 2), (-100, [1.0, 1.0, 1.0], 0)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS dim", "3 AS part", "4 AS w", "5 AS id").repartition(4)
    want = brute(rows)
    assert mined(df, part=50, page=8) == want and mined(df) == want


def test_empty_and_alone(spark):
    df = spark.createDataFrame([(100, [1.0], 1)], SCHEMA)
    assert mined(df.limit(0)) == [] == mined(df)


def test_other_numbers(spark):
    rows = [(k, [k / 10, 1.0], k % 2) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mined(df, every=13, k_positive=2, k_negative=1, scale=100, low=50, high=90)
    want = []
    for i in (0, 13, 26, 39):
        score = lambda j: math.floor(100 * (i / 10)) * math.floor(100 * (j / 10)) + 10000  # noqa: B023, E731
        own = sorted((-score(j), j) for j in range(40) if j % 2 == i % 2 and j != i)[:2]
        for s, p in own:
            hard = sorted((-score(j), j) for j in range(40) if j % 2 != i % 2 and -50 * s <= 100 * score(j) <= -90 * s)[:1]
            want += [(i, p, 1, j, -s, -t) for t, j in hard]
    assert got == sorted(want, key=repr) and want


def test_boxes_hold_their_rows_and_prune():
    rows = clusters(random.Random(7), 3000, 4, 0.05)
    vecs = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows], np.int32)
    pages = list(hn._tiles(vecs, np.arange(len(vecs)), 32, 3))
    assert sorted(np.concatenate(pages).tolist()) == list(range(3000)) and max(map(len, pages)) == 32
    n = len(pages)
    tree = hn.Tree(pa.table({
        "dim": pa.array([4] * n, pa.int32()), "page": pa.array(range(n), pa.int32()),
        "lo": hn._lists([vecs[p].min(0) for p in pages], pa.int32()), "hi": hn._lists([vecs[p].max(0) for p in pages], pa.int32()),
        "ids": hn._lists(pages, pa.int64()), "named": hn._lists([np.ones(len(p), bool) for p in pages], pa.bool_()),
        "labels": hn._lists([np.zeros(len(p), np.int64) for p in pages], pa.int64()),
        "keys": hn._lists(pages, pa.int64()), "vecs": hn._lists([vecs[p].ravel() for p in pages], pa.int32())}))
    query = vecs[:50].astype(np.float64)
    least, most = tree.intervals(query)
    opened = 0

    class Seen(np.ndarray):
        def __matmul__(self, other):
            nonlocal opened
            opened += 1
            return np.asarray(self) @ np.asarray(other)

    rows_ = tree.vecs.astype(np.float64).view(Seen)
    for q in range(50):
        score = tree.vecs.astype(np.float64) @ query[q]
        inside = [score[(tree.ends[b - 1] if b else 0):tree.ends[b]] for b in range(n)]
        assert all(least[q, b] <= s.min() and s.max() <= most[q, b] for b, s in enumerate(inside))
        got = tree.search(query[q], rows_, least[q].tolist(), most[q].tolist(), np.ones(3000, bool), [hn.LEAST], [-hn.LEAST], 5)
        assert [(-s, i) for s, _, i, _, _ in got[0]] == sorted(zip(score.tolist(), tree.ids.tolist()), key=lambda x: (-x[0], x[1]))[:5]
    assert opened < 50 * n / 4
