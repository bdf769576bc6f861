"""Operator 8 against all pairs that share a shingle."""

import collections
import random
import re

import numpy as np

from flowspark.llm import jaccard_join as J
from tests.conftest import SF_SMALL


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 4 else frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    index, parent = collections.defaultdict(list), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            parent[find(k)] = find(by_id.setdefault(i, k))
    for k, s in enumerate(sets):
        for j, n in collections.Counter(j for f in s for j in index[f]).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
        for f in s:
            index[f].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)), key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS sig")
    return sorted((tuple(r) for r in J.similarity_components(df).collect()), key=repr)


def near_copies(rnd, n_groups, size, words=120):
    out, i = [], 0
    for _ in range(n_groups):
        base = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.randint(3, words))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
                k = rnd.randrange(len(copy))
                copy[k:k + rnd.randint(0, 1)] = [f"w{rnd.randint(0, 5000)}"] * rnd.randint(0, 1)
                copy = copy or ["x"]
            out.append((i, " ".join(copy)))
            i += 1
    return out


def test_near_copies_of_all_sizes(spark):
    rnd = random.Random(8)
    rows = near_copies(rnd, 40, 6) + [(1000 + k, t) for k, t in near_copies(rnd, 2, 60, 400)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "One two"), (5004, "one TWO"), (5005, "one two three"),
             (5006, rows[10][1]), (None, rows[10][1]), rows[20], rows[20], (5007, "a b c d"), (5008, "a b c d e")]
    assert run(spark, rows) == brute(rows)


def test_chains_link_through_the_middle(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(9 - k, " ".join(base[4 * k:] + [f"z{j}" for j in range(4 * k)])) for k in range(10)]
    want = brute(rows)
    assert run(spark, rows) == want and len({r[2] for r in want}) < 10


def test_sets_of_one_id_are_linked(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " z"), (2, b), (3, b + " z"), (4, "One"), (4, c), (5, ""), (5, "two"), (None, a + " y"),
            (None, c + " z"), (None, "three")]
    want = brute(rows)
    assert run(spark, rows) == want and {r[2] for r in want if r[0] in (1, 2, 3)} == {1}


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_similar_sets_always_share_a_signature():
    rnd = np.random.default_rng(1)
    for n in [1, 2, 5, 6, 7, 12, 13, 14, 40, 85, 100, 300, 1000]:
        for _ in range(20):
            a = np.unique(rnd.integers(0, 1 << 62, n, dtype=np.uint64))
            common = -(-85 * len(a) // 100)
            for keep, extra in {(common, 0), (len(a), len(a) * 15 // 85), (max(common, len(a) - len(a) * 7 // 100), len(a) * 7 // 100)}:
                b = np.unique(np.concatenate([rnd.permutation(a)[:keep], rnd.integers(0, 1 << 62, extra, dtype=np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if 100 * inter < 85 * (len(a) + len(b) - inter):
                    continue
                sig, owner, _ = J.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert len(np.intersect1d(sig[owner == 0], sig[owner == 1])), (n, keep, extra)


def nested_pairs(n):
    """Texts of 48 shingles, each inside one of 56: unequal sizes, J = 0.857, two bands."""
    rnd, out = random.Random(12), []
    for _ in range(n):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(59)]
        out += [" ".join(words[:51]), " ".join(words)]
    return out


def test_pairs_of_unequal_size_share_a_signature_after_the_frequency_cut():
    texts = [t.encode() for t in nested_pairs(500)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    features, bounds = J.shingle_sets(np.frombuffer(b"".join(texts), np.uint8), offsets)
    held = collections.defaultdict(dict)
    for sig, owner, spare in zip(*(x.tolist() for x in J.signatures(features, bounds))):
        held[owner][sig] = spare >> 1
    for k in range(0, len(texts), 2):
        common = held[k].keys() & held[k + 1].keys()
        assert len(common) > max(held[o][s] for o in (k, k + 1) for s in common), k


def test_a_pair_of_unequal_size_with_few_common_signatures(spark):
    rows = list(enumerate(nested_pairs(468)[-2:]))  # shares 3 of the signatures that stay, no others are shared
    assert run(spark, rows) == brute(rows) == [(0, 48, 0), (1, 56, 0)]


def test_sketches_never_differ_in_more_bits_than_sets_in_features():
    rnd = np.random.default_rng(2)
    for n in (1, 10, 300, 3000):
        a = np.unique(rnd.integers(0, 1 << 62, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 5], rnd.integers(0, 1 << 62, n // 7, dtype=np.uint64)]))
        words = J.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
        assert int(np.bitwise_count(words[:, 0] ^ words[:, 1]).sum()) <= len(np.setxor1d(a, b))


def test_empty_table(spark):
    assert run(spark, []) == []
