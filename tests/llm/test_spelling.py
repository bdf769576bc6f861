"""Operator 11 against words found one by one and every deletion of every word."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from flowspark.llm import spelling
from flowspark.llm.tables import Scratch
from tests.conftest import SF_SMALL


def vocabulary(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def neighbours(words):
    near, same = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            left = w[:i] + w[i + 1:]
            same[i, left].append(w)
            if left in words:
                near[w].add(left)
                near[left].add(w)
    for group in same.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    return near


def brute(rows):
    v = vocabulary(rows)
    near = neighbours(v)
    form = {}
    for w, n in v.items():
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 10 * n else None
    out = set()
    for w, n in v.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), v[form[w]] if form[w] else None))
    return out


def variants(df, **options):
    rows = spelling.spelling_variants(df, **options).collect()
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert variants(docs) == want and any(w[1] for w in want)


def noisy(rnd, n):
    """Words of few letters and shared beginnings, in which most have neighbours."""
    letters, out = "aé÷", []
    for _ in range(n):
        word = rnd.choice(["éa", "prefixe", "prefixeprefixe"]) + "".join(rnd.choice(letters) for _ in range(rnd.randint(5, 6)))
        out += [word] * rnd.choice([1, 2, 3, 40, 900])
    rnd.shuffle(out)
    return out


def test_hot_prefixes_are_split_without_losing_a_pair(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(noisy(rnd, 20))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] and w[1] != w[2] for w in want)
    assert variants(df, group=8) == variants(df) == want


def test_nulls_blanks_repeats_long_words_and_other_columns(spark):
    long = "é" + "abcdefg" * 400
    rows = [(1, None), (2, ""), (None, "ABCDEFG abcdefg ABCDEFÀ"), (3, "1234567 x×÷ÿÀÖÞß"), (3, "1234567 x×÷ÿÀÖÞß"),
            (4, f"{long} {long[1:]} {long[:-1]}x {long}-{long[1:]} {long[:-1]}x"), (5, "Āabcdefgāabcdefg\x00abcdefg")]
    rows += [(10 + k, "abcdefgh " * 3 + "abcdefghi abcxefg " * (k % 2)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS word", "3 AS t", "4 AS n")
    assert variants(df) == variants(df, group=2) == brute(rows)
    assert variants(df.limit(0)) == set() == variants(df.limit(1))


def test_pairs_of_an_acceptor():
    rnd = random.Random(1)
    for trial in range(40):
        letters = rnd.choice(["ab", "abcé", "abcdefghijklmnopÿ"])
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(7, 9 + trial % 5)))
                        for _ in range(rnd.randint(1, 120))})
        near = neighbours(set(words))
        offsets, flat = spelling._flat(pa.array(words))
        for prefix in (0, 3, 6):
            a, b = spelling.accepted_pairs(offsets, flat, prefix)
            got = list(zip(a.tolist(), b.tolist()))
            assert len(got) == len(set(got))
            assert set(got) == {(i, j) for i, w in enumerate(words) for j, x in enumerate(words)
                                if i < j and x in near[w] and w[:prefix] == x[:prefix]}


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("walk", "talk", "chalk", "balk") for b in ("ed", "ing", "s", ""))
    m = spelling.Acceptor(*spelling._flat(pa.array(words)))
    rights = {w[:k]: frozenset(x[k:] for x in words if x.startswith(w[:k])) for w in words for k in range(len(w) + 1)}
    assert m.size == len(set(rights.values()))
    place = {}
    for w in words:  # the arcs' skips add up to the word's place
        s, at = m._node_state[0], 0
        for c in w.encode():
            arc = np.flatnonzero(m.key == s * 256 + c)[0]
            s, at = m.dst[arc], at + m.skip[arc]
        place[w] = at
        assert m.final[s]
    assert place == {w: k for k, w in enumerate(words)}


def test_one_hot_beginning_grows_in_proportion(spark):
    took = []
    for n in (4000, 16000):
        words = [f"shared{''.join(random.Random(k).choices('abcdefghij', k=9))}" for k in range(n)]
        df = spark.createDataFrame(list(enumerate(words)), "id long, word string")
        scratch = Scratch(spark, "spelling_test")
        began = time.time()
        pairs = spelling.near_pairs(df, scratch, group=500).collect()
        took.append(time.time() - began)
        near = neighbours(set(words))
        assert len(pairs) == sum(map(len, near.values())) // 2
    assert took[1] < 12 * took[0]
