"""Operator 1: language identification by cross-parsing entropy.

Each language has a suffix automaton of its labelled training text. A text is
parsed against it into phrases, each the longest match of the training text
from where the last phrase ended (a byte that occurs nowhere is a phrase of its
own). A phrase costs log2 of the training text's length, the bits that point
into it; the language whose phrases cost least per byte wins. Ties go to the
language first in code point order.

Training text is a bounded, seeded sample: labelled rows fall into
``train_rows`` hash slots per language, the distinct text with the least hash of
each slot is taken, and ``train_chars`` characters of it. The bound is
languages x train_rows x train_chars characters, whatever the table's size, and
copies of a text count once. Prediction reads whole texts.

The automata become one transition table per worker: next state and a bit that
says a phrase ended. Texts are lower-cased, ASCII other than letters becomes a
blank, and they are walked in parallel, a byte a step, in blocks of
``BLOCK`` bytes: a phrase ends where its block ends, so a text's blocks need not
wait for each other and a very long text is no longer walk than many short ones.

Defined results: null text, or text without a letter (``\\p{L}``), gives ``und``
and score 0, as does every text when nothing is labelled; repeated rows each
give their own row; only id, text and, for training, language are read, so other
columns may have any name; an empty table gives an empty table. ``score`` is the
runner-up's cost over the sum of both (0.5 to 1; 1 when only one language is known).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.textbytes import LOWER, slices
from flowspark.llm.workers import map_arrow

BLOCK = 2048
TRAIN_ROWS, TRAIN_CHARS = 64, 1024
UNKNOWN = "und"


def _normal_table() -> np.ndarray:
    table = LOWER.copy()
    ascii_other = [b for b in range(128) if not 97 <= table[b] <= 122]
    table[ascii_other] = 32
    return table


NORMAL = _normal_table()


def training_texts(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS
                   ) -> dict[str, list[str]]:
    """Texts per language; at most languages x train_rows x train_chars characters reach the driver."""
    labelled = (docs.filter(is_training & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
                .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
                .withColumn("h", F.xxhash64("text")))
    slot = F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(train_rows))
    least = labelled.groupBy("lang", slot.alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")
    taken = (labelled.join(F.broadcast(least), ["lang", "h"])  # one long per language and slot
             .select("lang", "h", F.substring("text", 1, train_chars).alias("text"))
             .groupBy("lang", "h").agg(F.min("text").alias("text")))
    out: dict[str, list[str]] = {}
    for row in sorted(taken.collect()):
        out.setdefault(row.lang, []).append(row.text)
    return out


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of ``text``."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step


class CrossParser:
    """Transition tables of all languages in one array: entry = next row * 2 + phrase ended."""

    def __init__(self, training: dict[str, list[str]]):
        self.langs = sorted(training)
        texts = {a: b"\n".join(NORMAL[np.frombuffer(t.lower().encode(), np.uint8)].tobytes() for t in training[a])
                 for a in self.langs}
        seen = np.unique(np.frombuffer(b"".join(texts.values()), np.uint8))
        self.column = np.zeros(256, np.int32)  # column 0: bytes that no language has
        self.column[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        self.bits = np.array([np.log2(len(texts[a]) + 1) for a in self.langs])
        tables, self.roots, at = [], [], 0
        for a in self.langs:
            step = suffix_automaton(texts[a])
            # A last state without arcs follows a byte that occurs nowhere. Where a state has no arc
            # the phrase ends, and the byte begins the next one; at a block's start none is open yet.
            begin = np.full(self.width, len(step), np.int64)
            for c, to in step[0].items():
                begin[self.column[c]] = to
            table = np.empty((len(step) + 1, self.width), np.int64)
            table[:] = ((begin + at) * self.width * 2 + 1)[None, :]
            table[0] -= 1
            state = np.repeat(np.arange(len(step)), [len(s) for s in step])
            symbol = np.array([c for s in step for c in s], np.int64)
            to = np.array([t for s in step for t in s.values()], np.int64)
            table[state, self.column[symbol]] = (to + at) * self.width * 2
            self.roots.append(at * self.width)
            at += len(step) + 1
            tables.append(table)
        self.table = np.concatenate(tables).ravel()
        if self.table.max(initial=0) < 1 << 31:
            self.table = self.table.astype(np.int32)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) against each language (columns)."""
        sizes = np.diff(offsets)
        blocks = -(-sizes // BLOCK)
        text_of = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offsets[text_of] + nth * BLOCK
        length = np.minimum(offsets[text_of + 1] - start, BLOCK)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        active = np.searchsorted(-length, -np.arange(BLOCK), "left")  # blocks longer than each step
        columns = self.column[data]
        kind = self.table.dtype
        state = np.repeat(np.array(self.roots, kind)[:, None], len(start), axis=1)
        count = np.ones(state.shape, np.int32)  # the phrase that is open at the block's end
        for t in range(int(length[0]) if len(length) else 0):
            n = active[t]
            v = self.table.take(state[:, :n] + columns[start[:n] + t])
            count[:, :n] += v & 1
            np.right_shift(v, 1, out=state[:, :n])
        out = np.zeros((len(sizes), len(self.langs)), np.int64)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(text_of[order], count[k], len(sizes))
        return out


_MADE: dict[str, CrossParser] = {}


def _parser(training: dict[str, list[str]]) -> CrossParser:
    key = repr(sorted(training.items()))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = CrossParser(training)
    return _MADE[key]


def predict_language(docs: DataFrame, training: dict[str, list[str]], id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, phrases) of every text; ``phrases`` are the winner's."""
    model = docs.sparkSession.sparkContext.broadcast(training)  # bounded by training_texts' parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(model.value) if model.value else None
        for batch in batches:
            for rows, offsets, _ in slices(batch, "t"):
                texts = rows.column("t")
                known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                lowered = pa.RecordBatch.from_arrays([pc.utf8_lower(texts)], ["t"])
                pred = np.full(rows.num_rows, UNKNOWN, object)
                score = np.zeros(rows.num_rows)
                used = np.zeros(rows.num_rows, np.int64)
                if parser:
                    _, offsets, data = next(slices(lowered, "t", 1 << 62))
                    phrases = parser.phrases(NORMAL[data], offsets)
                    cost = phrases * parser.bits
                    best = cost.argmin(1)
                    at = np.arange(len(best))
                    least = cost[at, best]
                    cost[at, best] = np.inf
                    second = cost.min(1)
                    share = np.ones(len(best))
                    both = np.isfinite(second)
                    share[both] = second[both] / np.maximum(second[both] + least[both], 1e-9)
                    pred = np.where(known, np.array(parser.langs, object)[best], pred)
                    score, used = np.where(known, share, 0.0), np.where(known, phrases[at, best], 0)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("i"), pa.array(pred, pa.string()), pa.array(score), pa.array(used)],
                    [id_col, "lang_pred", "score", "phrases"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), run,
                     f"`{id_col}` {kind}, lang_pred string, score double, phrases bigint")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id's text is 2 modulo 4."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))
