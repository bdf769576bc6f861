"""Operator 7 against the contract's patterns, matched one by one."""

import hashlib
import random
import re
import time

import pytest

from flowspark.llm import pii
from tests.conftest import SF_SMALL


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c)
        total += (x * 2 - 9 if x > 4 else x * 2) if k % 2 else x
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


# The contract's patterns as given.
PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def brute(text):
    found = sorted((m.start(), r, k, m.end()) for r, (k, p, ok) in enumerate(PATTERNS)
                   for m in re.finditer(p, text) if ok(m.group(0)))
    spans = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
    return (*(sum(f[2] == k for f in found) for k, _, _ in PATTERNS), hashlib.sha256(spans.encode()).hexdigest())


COLS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


def test_random_and_edge_texts(spark):
    rnd = random.Random(2)
    bits = ["a", "b.", "@", "x.y", "1", "22", "255", "256", ".", "-", " ", "+", "(", ")", "é", "😀", "4111111111111111",
            "4111 1111 1111 1111", "a@b.com", "_", "1.2.3.4", "+1 (017) 555-7713", "\n", "0000000", " "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "1" * 3000, "1 " * 3000, "a" * 3000 + "@b", "a@" + "b." * 3000 + "c", "+" * 1000 + "1" * 1000,
              "a.b@c.de_x@y.com", *("a@b.com 😀 " * k for k in (127, 128, 129, 300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS found")
    got = {r.doc_id: r for r in pii.pii_digests(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in COLS) == brute(t or ""), t
        assert {s for s in got[i].spans.split(",") if s.split(":")[0] in dict.fromkeys(k for k, _, _ in PATTERNS)} == {
            f"{k}:{m.start()}:{m.end()}" for k, p, ok in PATTERNS for m in re.finditer(p, t or "") if ok(m.group(0))}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in pii.pii_digests(docs).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}


@pytest.mark.parametrize("text,spans", [
    ("GB82 WEST 1234 5698 7654 32 iban", "iban:0:27"), ("GB82 WEST 1234 5698 7654 33 iban", ""),
    ("my ssn 123-45-6789", "ssn:7:18"), ("part 123-45-6789", ""),
    ('token = "d4e71e33b54f40bc277a32011430a66d5e984911"', "secret:9:49"),
    ("d4e71e33b54f40bc277a32011430a66d5e984911", ""),
])
def test_checksums_and_context_decide_added_kinds(spark, text, spans):
    got = pii.pii_digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert ",".join(s for s in got.split(",") if s.split(":")[0] in pii.ADDED_PATTERNS) == spans


def test_long_runs_are_linear_and_repeats_are_rows(spark):
    rows = [(1, "1" * 1_000_000), (1, "a" * 1_000_000 + "@"), (None, ("a@b.com " + "word " * 20) * 10_000), (2, "x"), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    assert sorted(r.n_email for r in pii.pii_digests(df).collect()) == [0, 0, 0, 0, 10_000]
    assert time.time() - began < 60
    assert pii.pii_digests(df.limit(0)).collect() == []
