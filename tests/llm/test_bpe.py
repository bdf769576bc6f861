"""Operator 6 against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowspark.llm.bpe import WordBpe, decode_ids, encode_digests, encode_texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return WordBpe(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_random_texts_equal_the_library(codec, library):
    rnd = random.Random(1)
    letters = "aabbccddee  \n\t'strelvmd.,!?<|>é́İΣςσßÀ\x1c\x85 　漢字क्षि१²Ⅷ😀👍🏽‍#$%&0123456789ABC"
    whole = ["<|endoftext|>", "<|startoftext|>", "<|endof", "aaaaaaaaaaaaaaaa", "'re", "won't", "\x00", "ﬁ", "Å", "ǅ"]
    for _ in range(5000):
        text = "".join(rnd.choice(whole) if rnd.random() < .1 else rnd.choice(letters)
                       for _ in range(rnd.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        got = codec.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False), text


@pytest.mark.parametrize("text", ["a" * 30000, "#$%" * 10000, "é" * 5000, "", " \n "])
def test_long_and_blank_texts(codec, library, text):
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows_nulls_repeats_and_other_columns(spark, library):
    rows = [(1, "Hello world", 5), (1, "Hello world", 6), (2, None, 7), (None, "x<|endoftext|>y", 8), (3, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((tuple(r) for r in encode_digests(df, PATH).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    ids = encode_texts(df, PATH)
    assert {r.decoded for r in decode_ids(ids, PATH).collect() if r.doc_id == 1} == {"hello</w> world</w>"}
    assert encode_digests(df.limit(0), PATH).collect() == []
