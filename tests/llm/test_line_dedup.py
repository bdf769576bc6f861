"""Operator 2 against templates counted in plain Python."""

import collections
import random

import pytest

from flowspark.llm import line_dedup as L
from tests.conftest import SF_SMALL


def brute(rows, min_docs):
    held, leaf, tokens = collections.defaultdict(set), {}, {}
    for d in set(rows):
        for x in (d[1] or "").split("\n"):
            p = L.parse_line(x)
            if p:
                held[p[2]].add(d)
                tokens[p[2]], leaf[p[2]] = p[0], p[1]
    in_leaf = collections.defaultdict(list)
    for t, k in leaf.items():
        in_leaf[k].append(t)
    general = {}
    for k, ts in in_leaf.items():
        if len(ts) < 2 or sum(len(held[t]) for t in ts) < min_docs:
            continue
        count = collections.Counter()
        for t in ts:
            for place, w in enumerate(tokens[t]):
                count[place, w] += len(held[t])
        for t in ts:
            kept = [(p, w) for p, w in enumerate(tokens[t]) if count[p, w] >= min_docs]
            if len(kept) >= L.SIMILAR * len(tokens[t]):
                general[t] = (k, tuple(kept))
    docs = collections.defaultdict(set)
    for t, ds in held.items():
        docs[general.get(t, t)] |= ds
    first = {t: min((d[0] for d in ds if d[0] is not None), default=None) for t, ds in docs.items() if len(ds) >= min_docs}
    out = []
    for i, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = []
        for x in lines:
            p = L.parse_line(x)
            t = p and general.get(p[2], p[2])
            if not (p and t in first and i != first[t]):
                kept.append(x)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(spark, rows, min_docs):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in L.drop_recurring_lines(df, min_docs=min_docs).collect()), key=repr)


@pytest.mark.parametrize("min_docs", [4, 10])
def test_templates_with_variable_fields(spark, min_docs):
    rnd = random.Random(4)
    words = ["user", "login", "from", "at", "error", "code", "x1", "y22", "ok", "fail"]
    rows = [(i, "\n".join(rnd.choice([
        f"user {rnd.randint(1, 99)} logged in from host {rnd.choice('abcdef')} ok", "copyright all rights reserved", "",
        " ", " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))]) for _ in range(rnd.randint(0, 6))))
        for i in range(200)]
    rows += [(None, "copyright all rights reserved"), (300, None), (301, ""), rows[3], rows[3],
             (3, "copyright all rights reserved\nx")]
    got = run(spark, rows, min_docs)
    assert got == brute(rows, min_docs) and sum(r[3] for r in got) > 100


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_other_columns_stay(spark):
    rows = [(i, f"value {i}\nsame line here", "en", i) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, line int")
    out = L.drop_recurring_lines(df, min_docs=3)
    assert out.columns == ["doc_id", "text", "lang", "line", "n_lines", "n_dropped"]
    got = {r.doc_id: (r.text, r.line) for r in out.collect()}
    assert got == {i: ("value 0\nsame line here" if i == 0 else "", i) for i in range(6)}
    assert L.drop_recurring_lines(df.limit(0)).collect() == []


def test_columns_of_any_name_are_returned_as_they_are(spark):
    names = ["__d", "__lines", "__k", "__", "d", "i", "t", "line", "leaf", "tpl", "template", "first"]
    rows = [(k, f"page {k} of the annual report\nown words {k} alpha{k}\nshared footer line") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    odd = L.drop_recurring_lines(df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in names]))
    plain = L.drop_recurring_lines(df)
    assert odd.columns == ["doc_id", "text", *names, "n_lines", "n_dropped"]
    got = odd.collect()
    assert all(r[c] == c for r in got for c in names)
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in got) == sorted((r.doc_id, r.text, r.n_dropped) for r in plain.collect())
