"""Operator 12 against targets found by resharing the excess round by round, in fractions."""

import hashlib
import math
import re
from fractions import Fraction

import pytest

from flowspark.llm import source_mix
from tests.conftest import SF_SMALL

COLS = ["size", "source_size", "target", "taken", "copies"]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Whole sources at their cap; the excess goes to the rest by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - 2 * sum(sizes[s] for s in capped)) / (sum(weight[s] for s in free) or 1)
        above = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not above:
            return {s: Fraction(2 * sizes[s]) if s in capped else level * weight[s] for s in names}
        capped |= above


def brute(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    goal = targets(sizes)
    out = []
    for i, text, source in rows:
        target = float(goal[source])
        rate = target / sizes[source] if sizes[source] else 0.0
        inner = "" if text is None else hashlib.md5(text.encode()).hexdigest()
        seed = f"{'' if i is None else i}:{inner}"
        u = int(hashlib.md5(seed.encode()).hexdigest()[:13], 16) / (1 << 52)
        copies = math.floor(rate) + (u < rate - math.floor(rate))
        out.append((i, source, words(text), sizes[source], target, words(text) * copies, copies))
    return sorted(out, key=repr)


def mixed(df):
    got = source_mix.mix(df)
    return sorted(((r.doc_id, r.source, *(r[c] for c in COLS)) for r in got.collect()), key=repr)


def same(got, want):
    assert [(*g[:4], *g[5:]) for g in got] == [(*w[:4], *w[5:]) for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-15)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "source")
    same(mixed(docs), brute([tuple(r) for r in docs.collect()]))


ROWS = [
    (1, "a b  c", "x"), (2, None, "x"), (3, "", "y"), (4, " \t\n\x0b\x0c\r ", "y"), (5, "w " * 3000, "hot"),
    (6, "one\x00two\x85three four", None), (None, "n n", None), (7, "v " * 40, "\U0001F600"), (8, "é ü", "￿"),
    (9, "r r", "x"), (9, "r r", "x"), (9, "r", "x"), *((100 + k, "t u v " * k, f"s{k % 7}") for k in range(60)),
]


def test_nulls_blanks_repeats_and_other_columns(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr(
        "*", "1 AS place", "2 AS weight", "3 AS ratio", "4 AS of", "4 AS `of_`", "5 AS capped")
    same(mixed(df), brute(ROWS))
    assert source_mix.mix(df).columns == [*df.columns, *["size", "source_size", "target", "copies", "taken"]]


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert mixed(df) == mixed(df.repartition(7)) == mixed(df.orderBy("text"))


def test_taken_words_come_near_the_targets(spark):
    df = spark.range(20000).selectExpr("id AS doc_id", "concat('w ', id) AS text",
                                       "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 8) END AS source")
    rows = source_mix.mix(df).groupBy("source").agg({"target": "max", "taken": "sum", "source_size": "max"}).collect()
    for r in rows:
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.08)
        assert r["max(target)"] <= 2 * r["max(source_size)"]


def test_emit_repeats_rows_without_the_figures(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    mix = source_mix.mix(df)
    want = sorted(repr((r.doc_id, r.text, r.source)) for r in mix.collect() for _ in range(r.copies))
    assert sorted(repr(tuple(r)) for r in source_mix.emit(mix).collect()) == want


def test_empty_table_wordless_corpus_and_clashing_names(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert source_mix.mix(df.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in source_mix.mix(blank).collect()] == [(0, 0.0, 0)] * 2
    with pytest.raises(ValueError, match="size"):
        source_mix.mix(df.withColumn("size", df.doc_id))


def test_other_weights_shares_and_caps(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 90), ("c", 100)], "source string, source_size long")
    got = {r.source: r.target for r in source_mix.source_targets(sizes, (3, 1), "0.5", "1.5").collect()}
    assert got == {"a": 15.0, "b": 85 / 4, "c": 85 * 3 / 4}


def test_plan_has_no_python(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    plan = source_mix.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
