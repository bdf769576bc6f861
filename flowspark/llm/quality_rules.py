"""Operator 4: quality rules with tokeniser fertility.

Base rules look at words: too few of them, or too many inside repeated 8-word
windows. Texts that pass are judged by how a public vocabulary splits them:

* characters per token: text unlike what the vocabulary knows splits finely
  (symbol salad, broken encodings), boilerplate of one long token coarsely;
* byte-fallback share: tokens that are one lone non-ASCII byte;
* token entropy in bits: repetitive text uses few tokens. Short texts cannot
  reach the entropy of long ones, so the floor grows with the logarithm of the
  token count up to a ceiling.

Each figure has a rejection band per language, else per script (the script most
of the text's letters are written in, read off the UTF-8 lead bytes). Bands are
fixed parameters, so a verdict depends on its own text alone.

Defined results: null text has no words, symbols, lines or tokens, and fails
the base rules, as does an empty one; texts are measured whole; repeated rows
each give their own row; a null or unknown language is judged by script; only
id, text and language columns are read, so other columns may have any name; an
empty table gives an empty table. A value on a band's edge is kept.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.textbytes import (BLANK, byte_class, mix, prefix_hashes, slices, span_hashes,
                                     window_hashes, word_bounds)
from flowspark.llm.workers import map_arrow

#: Fixed values of the base rules.
SYMBOLS = byte_class("#*$%&|<>")
WINDOW, MIN_WORDS, REPEAT_SHARE = 8, 20, (100, 30)
PIECE_CACHE = 1 << 18  # pieces whose ids a worker keeps; beyond it the cache starts anew


class Band(NamedTuple):
    """Limits of the verdict; the entropy floor is min(ceiling, base + slope * log2(tokens))."""

    min_chars: float
    max_chars: float
    max_fallback: float
    entropy_base: float = 1.0
    entropy_slope: float = 0.58
    entropy_ceiling: float = 6.25


#: By language code, else by script; "" is for the rest.
BANDS: Mapping[str, Band] = {
    "en": Band(2.1, 8.0, 0.10), "de": Band(2.1, 8.0, 0.15), "fr": Band(1.95, 8.0, 0.15), "es": Band(1.95, 8.0, 0.15),
    "Latin": Band(1.9, 9.0, 0.20), "Greek": Band(0.7, 6.0, 0.60), "Cyrillic": Band(0.9, 7.0, 0.60),
    "Hebrew": Band(0.6, 6.0, 0.70), "Arabic": Band(0.6, 6.0, 0.70), "Indic": Band(0.4, 6.0, 0.80),
    "Han": Band(0.3, 4.0, 0.90), "Hangul": Band(0.3, 4.0, 0.90), "": Band(0.25, 10.0, 0.95),
}
SCRIPTS = ["", "Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Indic", "Han", "Hangul"]


def _script_table() -> np.ndarray:
    """Script number by lead byte; 0 where a byte tells none."""
    table = np.zeros(256, np.uint8)
    for name, ranges in {"Latin": [(65, 91), (97, 123), (0xC3, 0xCB)], "Greek": [(0xCD, 0xD0)],
                         "Cyrillic": [(0xD0, 0xD4)], "Hebrew": [(0xD6, 0xD8)], "Arabic": [(0xD8, 0xDC)],
                         "Indic": [(0xE0, 0xE1)], "Han": [(0xE3, 0xEA)], "Hangul": [(0xEA, 0xEE)]}.items():
        for a, b in ranges:
            table[a:b] = SCRIPTS.index(name)
    return table


SCRIPT_OF = _script_table()


class Vocabulary:
    """A byte-level vocabulary given as ranks (one base64 token and its rank a line)."""

    def __init__(self, ranks: bytes, pattern: str):
        by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=by_bytes, special_tokens={})
        self.pieces = regex.compile(pattern).findall
        self.lone = np.zeros(max(by_bytes.values()) + 1, bool)
        self.lone[[r for t, r in by_bytes.items() if len(t) == 1 and t[0] >= 128]] = True
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Token ids as 32-bit integers; pieces do not depend on each other, so each is looked up."""
        pieces, known = self.pieces(text), self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        out = []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = np.array(self.encoding._encode_single_piece(p), np.uint32).tobytes()
                if len(known) >= PIECE_CACHE:
                    known.clear()
                if len(p) <= 64:
                    known[p] = ids
            out.append(ids)
        return b"".join(out)


_MADE: dict[str, Vocabulary] = {}


def _vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    key = hashlib.sha256(ranks).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Vocabulary(ranks, pattern)
    return _MADE[key]


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text's range."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype != float else float)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(words: np.ndarray, bounds: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """Words of each text inside k-word windows that the text holds twice or more."""
    text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    hashes = window_hashes(words, k)
    at = np.flatnonzero(text_of[:len(hashes)] == text_of[k - 1:])
    keys = mix(hashes[at] + text_of[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    hit = at[order[same[1:] | same[:-1]]] if len(at) else at
    steps = np.zeros(len(words) + 1, np.int32)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + k, -1)
    return _per_text(np.cumsum(steps[:-1]) > 0, bounds)


def _token_figures(ids: list[bytes], lone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, lone-byte tokens and entropy in bits of each text."""
    sizes = np.array([len(x) >> 2 for x in ids], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"".join(ids), np.uint32)
    text_of = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
    keys = np.sort(text_of << 32 | flat.astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    owner = keys[first] >> 32
    plogp = np.bincount(owner, counts * np.log2(counts), len(ids)) if len(first) else np.zeros(len(ids))
    n = np.maximum(sizes, 1)
    return sizes, _per_text(lone[flat], bounds), np.log2(n) - plogp / n


def quality_rules(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str | None = "lang", bands: Mapping[str, Band] = BANDS,
                  carry: list[str] | None = None) -> DataFrame:
    """One row a document: id, base figures, base_failed, kept, and the fertility figures.

    ``carry`` names further columns of ``docs`` to return as they are.
    """
    carry = carry or []
    sent = {c: "t" if c == text_col else f"c{k}" for k, c in enumerate(carry)}  # the text goes to Python once
    with open(ranks_path, "rb") as f:  # a public vocabulary of fixed size, sent once to each executor
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    table = [[tuple(bands.get(s, bands[""]))] for s in SCRIPTS]
    by_lang = {k: tuple(v) for k, v in bands.items()}

    def figures(rows: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray, vocabulary: Vocabulary) -> list:
        starts, ends, bounds = word_bounds(data, offsets, ~BLANK)
        letter = (data & 0xC0) != 0x80
        n_words = np.diff(bounds)
        chars = _per_text(letter, offsets)
        word_chars = _per_text(letter & ~BLANK[data], offsets)
        symbols = _per_text(SYMBOLS[data], offsets)
        repeats = repeated_words(span_hashes(prefix_hashes(data), starts, ends), bounds)
        texts = [t or "" for t in rows.column("t").to_pylist()]
        dup = []
        for t in texts:
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            dup.append(len(lines) - len(set(lines)))
        failed = (n_words < MIN_WORDS) | (REPEAT_SHARE[0] * repeats > REPEAT_SHARE[1] * n_words)
        tokens, lone, entropy = _token_figures([vocabulary.ids(t) for t in texts], vocabulary.lone)
        kinds = SCRIPT_OF[data].astype(np.int64)
        text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
        scripts = np.bincount(text_of * len(SCRIPTS) + kinds, minlength=len(texts) * len(SCRIPTS))
        scripts = scripts.reshape(len(texts), len(SCRIPTS))
        scripts[:, 0] = 0
        script = scripts.argmax(1)
        langs = rows.column("l").to_pylist()
        band = np.array([by_lang.get(a) if a in by_lang and a else table[s][0] for a, s in zip(langs, script)])
        n = np.maximum(tokens, 1)
        per_token, fallback = chars / n, lone / n
        floor = np.minimum(band[:, 5], band[:, 3] + band[:, 4] * np.log2(n))
        good = ((per_token >= band[:, 0]) & (per_token <= band[:, 1]) & (fallback <= band[:, 2]) & (entropy >= floor))
        return [n_words, word_chars, symbols, np.array(dup, np.int64), repeats, failed, ~failed & good,
                per_token, fallback, entropy, pa.array([SCRIPTS[s] for s in script])]

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "chars_per_token", "byte_fallback", "token_entropy", "script"]
    kinds = ["bigint"] * 5 + ["boolean"] * 2 + ["double"] * 3 + ["string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks.value, pattern)
        for batch in batches:
            for rows, offsets, data in slices(batch, "t"):
                out = [pa.array(x) for x in figures(rows, offsets, data, vocabulary)]
                yield pa.RecordBatch.from_arrays([rows.column("i"), *(rows.column(c) for c in sent.values()), *out],
                                                 [id_col, *carry, *names])

    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    schema = [(c, docs.schema[c].dataType.simpleString()) for c in [id_col, *carry]] + list(zip(names, kinds))
    return map_arrow(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), lang.alias("l"),
                       *[F.col(c).alias(x) for c, x in sent.items() if x != "t"]),
                     run, ", ".join(f"`{a}` {b}" for a, b in schema))
