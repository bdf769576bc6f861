"""The pipeline's stages against the operators' brute-force versions, one on another's rows."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from flowspark.llm.quality_rules import quality_rules
from tests.conftest import SF_SMALL
from tests.llm import test_decontamination, test_jaccard_join, test_line_dedup


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {r.doc_id for r in quality_rules(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                            public_tokenizers.PATTERN).collect() if r.kept}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    rows = [(i, t) for i, t, _, _ in test_line_dedup.brute(rows, 10)]
    leaders = {c for _, _, c in test_jaccard_join.brute(rows)}
    rows = [r for r in rows if r[0] in leaders]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    bad = {r[0] for r in test_decontamination.brute(rows, items) if r[-1]}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        if i not in bad:
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert bad and sorted(map(tuple, P.run(spark, SF_SMALL).collect())) == sorted(want)


def test_stages_keep_columns_and_take_odd_rows(spark):
    prose = " ".join(f"word{k} and then some other text number {k}" for k in range(20))
    rows = [(1, prose, "en", "s", 1), (2, prose, "en", "s", 1), (2, prose, "en", "s", 1), (None, prose + " x", None, None, None),
            (3, None, "en", "s", 0), (4, "", None, "s", 0), (5, "short", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    inner = ["node", "template", "kept", "n_words", "script", "n_lines", "n_dropped", "carried", "component", "c0", "__d", "__lines",
             "__k", "text_hash", "bad_id", "kept_id", "contaminated", "a b.c"]
    real = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*docs.columns).orderBy("doc_id").limit(8)
    clash = docs.union(real).selectExpr("*", *[f"'{c}' AS `{c}`" for c in inner])
    for odd in (docs, docs.limit(0), clash):
        for name, stage in P.STAGES:
            out = stage(spark, odd, SF_SMALL)
            if name != "bpe":
                assert out.columns == odd.columns, name
            rows_ = out.collect()
            if odd is clash and name != "bpe":
                assert rows_ and all(r[c] == c for r in rows_ for c in inner)
    near = {r.doc_id for r in P.near_copies(spark, docs, SF_SMALL).collect()}
    assert near == {1, 3, 4, 5}


def test_near_copies_keep_one_row_of_null_and_repeated_ids(spark):
    prose = " ".join(f"word{k} and then some other text number {k}" for k in range(20))
    other = " ".join(f"thing{k} with quite different words number {k}" for k in range(20))
    rows = [(None, prose, "a"), (None, prose + " x", "b"), (None, other, "c"), (None, other + " y", "d"), (7, other + " z", "e"),
            (9, "one two", "f"), (9, "one two", "g"), (9, "three", "h"), (None, None, "i"), (None, "", "j"), (8, " ", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = P.near_copies(spark, docs, SF_SMALL).collect()
    left = {(r.doc_id, r.text) for r in got}
    assert len(got) == len(left) == 6
    assert {(7, other + " z"), (None, None), (None, ""), (8, " ")} < left
    assert len(left & {(None, prose), (None, prose + " x")}) == 1 and len(left & {(9, "one two"), (9, "three")}) == 1
