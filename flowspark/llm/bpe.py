"""Operator 6: byte-level BPE by a tokenization automaton.

The merges are compiled, in rank order, into a deterministic automaton over
token labels: its state is the label read last, and it accepts exactly the
token sequences that BPE produces. It begins with every base symbol allowed
after every other. The gadget of merge ``(u, v) -> uv`` (rank r)

* adds the label ``uv``: its arcs enter from wherever ``u`` could be read, and
  the state it leads to is a copy of the state after ``v``;
* cuts ``v`` out of the state after ``u``.

Copies are kept as references with the rank at which they were taken, so the
automaton has one record a merge instead of labels squared arcs; an arc is
resolved through its copies once and then stands in the transition table.
A pre-split word is encoded by walking a byte trie of the labels and the
transition table together: one accepting path exists, and longest labels are
tried first. Decoding emits the arcs' labels.

Text handling (fixed by the tokenizer file): special tokens are split off the
raw text, the rest is NFC-normalised, lower-cased and pre-split by the file's
pattern, white space dropped; ``</w>`` ends each word.

Defined results: null or empty text gives no tokens (hash of nothing); a text
is encoded whole; repeated rows each give their own row; only the id and text
columns are read, so other columns may have any name; an empty table gives an
empty table. Characters outside the alphabet do not exist (bytes cover all).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from flowspark.llm.workers import map_arrow

WORD_CACHE = 1 << 18  # words whose ids a worker keeps; beyond it the cache starts anew

#: Fixed value: white space as the tokenizer file's pattern takes it.
WHITE = r"\t-\r \x85\xa0  -     　"


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """Labels are token ids; see the module's text for states, gadgets and arcs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = byte_letters()
        self.left, self.right, self.rank, self.cut = {}, {}, {}, {}
        self.arcs: dict[int, bool] = {}
        self.step: dict[int, int] = {}
        self.inner: list[int] = [-1]
        self.final: list[int] = [-1]
        for letter in letters:
            for form in (letter, letter + suffix):
                self.rank[vocab[form]] = -1
                self._spell(letters, form, vocab[form], suffix)
        for r, (a, b) in enumerate(merges):
            if self._gadget(r, vocab[a], vocab[b], vocab[a + b]):
                self._spell(letters, a + b, vocab[a + b], suffix)

    def _gadget(self, r: int, u: int, v: int, uv: int) -> bool:
        """False when no path reads u, v at this rank: the new label gets no arc."""
        if uv in self.rank:
            raise ValueError("a label is produced by two merges")
        read = self._open(u, v, r)
        self.rank[uv], self.left[uv], self.right[uv] = r, u, v
        if read:
            self.cut[u, v] = r
        return read

    def _spell(self, letters: dict[str, int], form: str, label: int, suffix: str) -> None:
        ends = form.endswith(suffix)
        node = 0
        for c in form[:-len(suffix)] if ends else form:
            key = node << 8 | letters[c]
            if key not in self.step:
                self.step[key] = len(self.inner)
                self.inner.append(-1)
                self.final.append(-1)
            node = self.step[key]
        (self.final if ends else self.inner)[node] = label

    def _open(self, q: int, t: int, before: float) -> bool:
        """Whether label t can follow label q once the gadgets of ranks under ``before`` are in."""
        rank, cut = self.rank, self.cut
        while True:
            if cut.get((q, t), before) < before:
                return False
            rq, rt = rank[q], rank[t]
            if rq < 0 and rt < 0:
                return True
            if rt > rq:  # t's arcs are a copy of its left part's; leftmost merges go first
                t, before = self.left[t], rt + 1
            elif rq > rt:  # the state after q is a copy of that after its right part
                q, before = self.right[q], rq
            else:
                q, t, before = self.right[q], self.left[t], rq

    def follows(self, q: int, t: int) -> bool:
        key = q << 20 | t
        known = self.arcs.get(key)
        if known is None:
            known = self.arcs[key] = self._open(q, t, float("inf"))
        return known

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one accepting path that spells the word."""
        n = len(word)
        step, inner, final = self.step, self.inner, self.final

        def labels(at: int) -> list[tuple[int, int]]:
            node, out = 0, []
            for i in range(at, n):
                node = step.get(node << 8 | word[i], -1)
                if node < 0:
                    break
                label = final[node] if i + 1 == n else inner[node]
                if label >= 0:
                    out.append((label, i + 1))
            return out  # longest last

        path: list[int] = []
        ends: list[int] = []
        todo = [labels(0)]
        dead: set[tuple[int, int]] = set()
        while True:
            q = path[-1] if path else -1
            at = ends[-1] if ends else 0
            options = todo[-1]
            while options:
                label, end = options.pop()
                if (end, label) not in dead and (q < 0 or self.follows(q, label)):
                    path.append(label)
                    ends.append(end)
                    break
            else:
                if not path:
                    raise ValueError("no accepting path")
                dead.add((at, q))
                todo.pop()
                path.pop()
                ends.pop()
                continue
            if ends[-1] == n:
                return path
            todo.append(labels(ends[-1]))


class WordBpe:
    """Encodes and decodes texts with the automaton of one tokenizer file."""

    def __init__(self, spec: bytes):
        model = json.loads(spec)
        bpe, vocab = model["model"], model["model"]["vocab"]
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True)))
                                           + ")") if special else None
        steps = model["pre_tokenizer"]["pretokenizers"]
        pattern = next(p["pattern"]["Regex"] for p in steps if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", WHITE)).findall
        self.automaton = MergeAutomaton(vocab, [tuple(m) for m in bpe["merges"]], bpe["end_of_word_suffix"])
        self.labels = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for label, i in (vocab | special).items():
            self.labels[i] = label
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words = self.words(text)
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.automaton.encode(w.encode()), "<u4").tobytes()
                if len(known) >= WORD_CACHE:
                    known.clear()
                if len(w) <= 64:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.special or "<|" not in text and not any(s in text for s in self.special):
            return self._ids(text)
        return b"".join(np.uint32(self.special[part]).tobytes() if part in self.special else self._ids(part)
                        for part in self.split_special.split(text) if part)

    def decode(self, ids: bytes) -> str:
        """The arcs' labels, blank-joined, special tokens kept."""
        return " ".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MADE: dict[str, WordBpe] = {}


def _codec(spec: bytes) -> WordBpe:
    key = hashlib.sha256(spec).hexdigest()
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = WordBpe(spec)
    return _MADE[key]


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<long>) of every text, with the tokenizer file at ``path``."""
    return _mapped(docs, path, id_col, text_col, "ids array<bigint>", digests=False)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the text is encoded, and its ids are decoded again."""
    return _mapped(docs, path, id_col, text_col,
                   "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digests=True)


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded string) of arrays of ids; null gives an empty string."""
    with open(path, "rb") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in batches:
            texts = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_arrow(encoded.select(id_col, ids_col), run, f"`{id_col}` {kind}, decoded string")


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, digests: bool) -> DataFrame:
    with open(path, "rb") as f:  # a public vocabulary of fixed size, sent once to each executor
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                ids = [codec.encode(t or "") for t in b.column(1).to_pylist()]
                if digests:
                    out = [pa.array([len(x) // 4 for x in ids], pa.int64()),
                           pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                           pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids])]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    out = [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64()))]
                    names = ["ids"]
                yield pa.RecordBatch.from_arrays([b.column(0), *out], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, {schema}")
