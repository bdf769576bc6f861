"""Operator 11: spelling variants by composing the vocabulary acceptor, a one-edit transducer and the acceptor.

Words are kept as Latin-1 bytes (the contract's letters end at U+00FF), one byte
a code point. Near pairs are the accepted pairs of ``A o E o A``, where A is the
minimised acceptor of the vocabulary and E replaces, deletes or inserts exactly
one letter. The composition is split by its initial states:

- A pair's first difference lies within the first ``PREFIX`` letters or both
  words share those letters. In the first case E takes its edit arc before any
  such initial state is reached and both words then read the same rest: each
  word sends the readings that are left when E deletes one of those letters, a
  shuffle brings equal readings together, and two words that delete at the same
  place, or a word and a reading equal to it, are a pair. At most one word per
  letter can share a reading and a place, so no group grows with the data.
- In the second case the words pass the same initial state, the one after their
  shared prefix. Prefixes are dealt to tasks whole, and each task builds the
  minimised acceptor of a bounded number of words, composes it, drops the states
  that lead nowhere and enumerates the accepted pairs from those initial states.
- A prefix with more than ``GROUP`` words is split the same way: its pairs whose
  first difference lies within the next letters by readings, the others under
  prefixes of twice the length, until none is too large.

Defined results: null texts have no words; a null id reads as an empty one; rows
with equal id and text count as often as they stand; only id and text columns
are read, so others may have any name; an empty table gives an empty table.
A word longer than a task's letters makes a batch of its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.tables import Scratch
from flowspark.llm.textbytes import mix
from flowspark.llm.workers import map_arrow

MIN_LETTERS, MIN_COUNT = 7, 2  # fixed values: the contract's words
NOISE, RATIO = 31, 10          # fixed values: one run in 31 loses a letter; a form is 10 times as frequent
PREFIX = 3
GROUP = 1 << 14                # words an acceptor is built for, and letters by 2**4
FLUSH = 1 << 17                # distinct words held while counting
#: A-Z to a-z, all other letters as they are.
LOWER = {c: c + 32 for c in range(65, 91)}
RUNS = re.compile(r"[A-Za-zÀ-ÿ]+")


# --- the vocabulary

def _words_of(doc_id: str, text: str, shortest: int) -> Counter:
    """Lower-cased runs of at least ``shortest`` letters, some of which lose a letter by their checksum."""
    raw = Counter(m[0] for m in re.finditer(rf"[A-Za-zÀ-ÿ]{{{shortest},}}", text))
    lowered, out = Counter(), Counter()
    for run, n in raw.items():
        lowered[run.lower() if run.isascii() else run.translate(LOWER)] += n
    for run, n in lowered.items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % NOISE == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
            if len(run) < shortest:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str, text_col: str, min_letters: int = MIN_LETTERS,
               min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all documents; counts are summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()),
                                                pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("i"), batch.column("t")):
                held.update(_words_of(doc_id.as_py(), text.as_py(), min_letters))
                if len(held) > FLUSH:
                    yield out()
        yield out()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    return (map_arrow(texts.filter("t is not null"), run, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


# --- flat arrays of words

def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, letters) of a column of words, one byte a letter."""
    rows = [w.encode("latin-1") for w in words.to_pylist()]
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return offsets, np.frombuffer(b"".join(rows), np.uint8)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): every owner k appears ``counts[k]`` times, with places 0, 1, ..."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _runs(batches: Iterator[pa.RecordBatch], key: str, at_least: int, letters: int | None = None
          ) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` in pieces of ``at_least`` rows (or ``letters`` letters) that end where a key ends."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for whole in batches:
        for batch in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
            held.append(batch)
            rows += batch.num_rows
            size += batch.nbytes
            if rows >= at_least or (letters and size >= letters):
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table.column(key).to_pylist()
                cut = next((k for k in range(len(keys) - 1, 0, -1) if keys[k] != keys[-1]), -1) + 1
                if cut:
                    yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                rows = table.num_rows - cut
                size = size * rows // max(1, table.num_rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


# --- edits before the initial state: equal readings

def _seeded(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_TABLES = (_seeded(1), _seeded(2))
_ODD = 0xD1342543DE82EF95


def readings(offsets: np.ndarray, letters: np.ndarray, first: int, last: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, hash, hash): each word (place -1) and what is left of it without the letter at each place in [first, last)."""
    lengths = np.diff(offsets)
    power = np.ones(int(lengths.max(initial=0)) + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(len(power) - 1, _ODD, np.uint64))
    place_in = np.arange(len(letters)) - np.repeat(offsets[:-1], lengths)
    word, k = _spread(np.clip(np.minimum(lengths, last) - first, 0, None))
    k = k + first
    at = offsets[word] + k
    hashes = []
    back = np.uint64(pow(_ODD, -1, 1 << 64))
    for table in _TABLES:
        run = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(table[letters] * power[place_in], out=run[1:])
        whole = run[offsets[1:]] - run[offsets[:-1]]
        left = (run[at] - run[offsets[word]]) + (run[offsets[word + 1]] - run[at + 1]) * back
        hashes.append(np.concatenate([mix(whole + lengths.astype(np.uint64)),
                                      mix(left + (lengths[word] - 1).astype(np.uint64))]).view(np.int64))
    return (np.concatenate([np.arange(len(lengths)), word]),
            np.concatenate([np.full(len(lengths), -1), k]), *hashes)


def reading_pairs(words: DataFrame, first: int, last: int, tasks: int) -> DataFrame:
    """(a, b): ids of near words whose first difference is at a place in [first, last)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 4096) for k in range(0, whole.num_rows, 4096)):
                word, place, h, g = readings(*_flat(batch.column("word")), first, last)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(g), pa.array(place.astype(np.int32)),
                     batch.column("id").take(pa.array(word))], ["h", "g", "place", "id"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "h", 1 << 16):
            h, g, place, ids = (t.column(c).to_numpy() for c in ("h", "g", "place", "id"))
            a, b = [], []
            for step in range(1, len(h)):
                near = (h[step:] == h[:-step]) & (g[step:] == g[:-step])
                if not near.any():
                    break
                # rows of a reading are in order of place, so a whole word comes first
                near &= (place[step:] == place[:-step]) | (place[:-step] < 0)
                near &= ids[step:] != ids[:-step]
                k = np.flatnonzero(near)
                a.append(ids[k])
                b.append(ids[k + step])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    rows = map_arrow(words.select("id", "word"), emit, "h bigint, g bigint, place int, id bigint")
    return map_arrow(rows.repartition(tasks, "h").sortWithinPartitions("h", "g", "place", "id"), pair, "a bigint, b bigint")


# --- the minimised acceptor and its composition

class Acceptor:
    """Minimal deterministic acceptor of sorted, distinct words.

    ``dst``, ``skip`` and ``label`` are its arcs, ordered by state and label, with ``start[s]``
    and ``deg[s]`` for state s. ``skip`` counts the words passed over when an arc
    is taken, so the sum along a path is the place of the word in the order.
    """

    def __init__(self, offsets: np.ndarray, letters: np.ndarray):
        n, lengths = len(offsets) - 1, np.diff(offsets)
        shared = self._shared(offsets, letters)
        new = lengths - shared
        owner, k = _spread(new)
        depth = np.concatenate([[0], shared[owner] + k + 1])  # node 0 is the root
        first_word = np.concatenate([[0], owner])
        label = np.concatenate([[0], letters[offsets[owner] + shared[owner] + k]]).astype(np.int64)
        nodes = len(depth)
        base = 1 + np.cumsum(new) - new
        by_depth = np.lexsort((np.arange(nodes), depth))
        code = depth[by_depth] * (nodes + 1) + by_depth
        # a word's first new node hangs from the latest node at the depth it shares with the word before
        parent = np.arange(-1, nodes - 1)
        head = base[new > 0]
        parent[head] = by_depth[np.searchsorted(code, shared[new > 0] * (nodes + 1) + head) - 1]
        final = np.zeros(nodes, bool)
        final[base + new - 1] = True

        self.path_class, self.nodes = None, nodes
        levels = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
        seed = 1
        while True:
            state, arcs = self._merge(by_depth, levels, parent, label, final, seed)
            if state is not None:
                break
            seed += 1
        keep, child = arcs
        self.size = int(state.max()) + 1
        self.final = np.zeros(self.size, bool)
        self.final[state] = final
        src = state[parent[child]]
        order = np.argsort(src * 256 + label[child], kind="stable")
        child = child[order]
        self.key = src[order] * 256 + label[child]
        self.label, self.dst = label[child], state[child]
        self.skip = first_word[child] - first_word[parent[child]]
        self.deg = np.bincount(src, minlength=self.size)
        self.start = np.cumsum(self.deg) - self.deg
        self._node_state, self._depth = state, depth
        self._base, self._shared_with, self._parent, self._first_word = base, shared, parent, first_word

    @staticmethod
    def _shared(offsets: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """How many letters each word shares with the one before it."""
        lengths = np.diff(offsets)
        shared = np.zeros(len(lengths), np.int64)
        live = np.arange(1, len(lengths))
        k = 0
        while len(live):
            live = live[(lengths[live] > k) & (lengths[live - 1] > k)]
            live = live[letters[offsets[live] + k] == letters[offsets[live - 1] + k]]
            shared[live] += 1
            k += 1
        return shared

    @staticmethod
    def _merge(by_depth, levels, parent, label, final, seed):
        """State of every node: nodes with the same right language share one. None if two languages got one hash."""
        n = len(parent)
        sign = final.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed)
        for d in range(len(levels) - 2, 0, -1):
            at = by_depth[levels[d]:levels[d + 1]]
            arc = mix(mix(sign[at]) + label[at].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
            up = parent[at]  # not falling, as nodes are in word order
            heads = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            sign[up[heads]] += np.add.reduceat(arc, heads)
        _, first, state = np.unique(sign, return_index=True, return_inverse=True)
        # check: every node has its state's final flag, and its arcs lead to the same states by the same letters
        child = np.lexsort((label[1:], parent[1:])) + 1
        deg = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n, np.int64)
        begin = np.cumsum(deg) - deg
        chosen = first[state]
        if (final != final[chosen]).any() or (deg != deg[chosen]).any():
            return None, None
        owner, k = _spread(deg)
        twin = child[begin[chosen[owner]] + k]
        if (label[child] != label[twin]).any() or (state[child] != state[twin]).any():
            return None, None
        own = np.flatnonzero(chosen[parent[child]] == parent[child]) if n > 1 else np.zeros(0, np.int64)
        return state, (chosen, child[own])

    def initial(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(state, word): the nodes ``length`` letters deep and the place of the first word below each."""
        at = np.flatnonzero(self._depth == length)
        return self._node_state[at], self._first_word[at]

    def below(self, states: np.ndarray) -> np.ndarray:
        """Flags of the states reached from ``states``."""
        seen = np.zeros(self.size, bool)
        while len(states):
            seen[states] = True
            owner, k = _spread(self.deg[states])
            states = np.unique(self.dst[self.start[states[owner]] + k])
            states = states[~seen[states]]
        return seen

    def common(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, arc of p, arc of q) for the letters that both states of a row read."""
        swap = self.deg[p] > self.deg[q]
        small, large = np.where(swap, q, p), np.where(swap, p, q)
        row, k = _spread(self.deg[small])
        one = self.start[small[row]] + k
        want = large[row] * 256 + self.label[one]
        other = np.searchsorted(self.key, want)
        hit = np.flatnonzero(self.key[np.minimum(other, len(self.key) - 1)] == want) if len(self.key) else other[:0]
        row, one, other = row[hit], one[hit], other[hit]
        return row, np.where(swap[row], other, one), np.where(swap[row], one, other)


def _edits(m: Acceptor, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, arc, arc): E's edit at each state; the second arc is -1 where the first word has a letter more."""
    row, k = _spread(m.deg[states])
    arc = m.start[states[row]] + k
    more, j = _spread(m.deg[states[row]] - k - 1)
    return (np.concatenate([row[more], row]), np.concatenate([arc[more], arc]),
            np.concatenate([arc[more] + 1 + j, np.full(len(arc), -1)]))


class Edited:
    """The composed states after the edit, as pairs of acceptor states, that reach a pair of final states."""

    def __init__(self, m: Acceptor, states: np.ndarray):
        self.m = m
        row, one, other = _edits(m, states)
        after = self.code(m.dst[one], np.where(other < 0, states[row], m.dst[other]))
        seen = frontier = np.unique(after)
        up, down = [], []
        while len(frontier):
            p, q = frontier // m.size, frontier % m.size
            apart = np.flatnonzero(p != q)  # equal states read the same words: they need no walk
            row, a, b = m.common(p[apart], q[apart])
            to = self.code(m.dst[a], m.dst[b])
            up.append(frontier[apart][row])
            down.append(to)
            frontier = np.setdiff1d(to, seen)
            seen = np.union1d(seen, frontier)
        p, q = seen // m.size, seen % m.size
        live = (p == q) | (m.final[p] & m.final[q])
        up = np.searchsorted(seen, np.concatenate(up)) if up else np.zeros(0, np.int64)
        down = np.searchsorted(seen, np.concatenate(down)) if down else np.zeros(0, np.int64)
        order = np.argsort(down, kind="stable")
        up, down = up[order], down[order]
        begin = np.searchsorted(down, np.arange(len(seen) + 1))
        fresh = np.flatnonzero(live)
        while len(fresh):  # back from the accepting states
            row, k = _spread(begin[fresh + 1] - begin[fresh])
            fresh = np.unique(up[begin[fresh[row]] + k])
            fresh = fresh[~live[fresh]]
            live[fresh] = True
        self.live = seen[live]

    def code(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.minimum(p, q) * self.m.size + np.maximum(p, q)

    def reaches(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        code = self.code(p, q)
        if not len(self.live):
            return np.zeros(len(code), bool)
        return (p == q) | (self.live[np.minimum(np.searchsorted(self.live, code), len(self.live) - 1)] == code)


def accepted_pairs(offsets: np.ndarray, letters: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words (of sorted, distinct ones) that share their first ``prefix`` letters; each pair once."""
    m = Acceptor(offsets, letters)
    state, word = m.initial(prefix)
    reached = np.flatnonzero(m.below(np.unique(state)))
    edited = Edited(m, reached)
    row, one, other = _edits(m, reached)
    after = np.where(other < 0, reached[row], m.dst[other])
    leaves = np.zeros(m.size, bool)  # unedited states with a way to an accepted pair
    leaves[reached[row[edited.reaches(m.dst[one], after)]]] = True
    src = np.repeat(np.arange(m.size), m.deg)
    order = np.argsort(m.dst, kind="stable")
    begin = np.searchsorted(m.dst[order], np.arange(m.size + 1))
    fresh = np.flatnonzero(leaves)
    while len(fresh):
        row, k = _spread(begin[fresh + 1] - begin[fresh])
        fresh = np.unique(src[order[begin[fresh[row]] + k]])
        fresh = fresh[~leaves[fresh]]
        leaves[fresh] = True

    found_a, found_b = [], []
    live = leaves[state]
    state, word = state[live], word[live]
    p = q = a = b = np.zeros(0, np.int64)
    while len(state) or len(p):
        row, x, y = _edits(m, state)
        to_p, to_q = m.dst[x], np.where(y < 0, state[row], m.dst[y])
        use = edited.reaches(to_p, to_q)
        row, x, y = row[use], x[use], y[use]
        new = (to_p[use], to_q[use], word[row] + m.skip[x], word[row] + np.where(y < 0, 0, m.skip[y]))
        both, i, j = m.common(p, q)
        use = edited.reaches(m.dst[i], m.dst[j])
        both, i, j = both[use], i[use], j[use]
        p, q, a, b = (np.concatenate(c) for c in zip(
            new, (m.dst[i], m.dst[j], a[both] + m.skip[i], b[both] + m.skip[j])))
        done = m.final[p] & m.final[q]
        found_a.append(a[done])
        found_b.append(b[done])
        row, k = _spread(m.deg[state])
        arc = m.start[state[row]] + k
        use = leaves[m.dst[arc]]
        state, word = m.dst[arc[use]], word[row[use]] + m.skip[arc[use]]
    a, b = np.concatenate(found_a or [a]), np.concatenate(found_b or [b])
    n = len(offsets) - 1
    pairs = np.unique(np.minimum(a, b) * n + np.maximum(a, b))  # a doubled letter can be dropped twice over
    return pairs // n, pairs % n


def accepted(words: DataFrame, prefix: int, tasks: int, group: int) -> DataFrame:
    """(a, b): ids of near words that share their first ``prefix`` letters; ``words`` holds whole prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "prefix", group, group << 6):
            offsets, letters = _flat(t.column("word"))
            a, b = accepted_pairs(offsets, letters, prefix)
            ids = t.column("id").to_numpy()
            for k in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[k:k + (1 << 16)]]), pa.array(ids[b[k:k + (1 << 16)]])],
                                                 ["a", "b"])

    rows = words.select("id", "word", F.substring("word", 1, prefix).alias("prefix"))
    return map_arrow(rows.repartition(tasks, "prefix").sortWithinPartitions("word"), run, "a bigint, b bigint")


# --- the operator

def near_pairs(words: DataFrame, scratch: Scratch, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """(a, b), each pair once: ids of ``words`` (id, word) that differ by one inserted, deleted or replaced letter.

    Eager: one or two tables for each doubling of the prefix, until no prefix has more than ``group`` words.
    """
    first, last, found = 0, prefix, []
    while True:
        tasks = max(1, math.ceil(words.count() / group))
        found.append(scratch.save(reading_pairs(words, first, last, tasks), f"readings{last}"))
        key = F.substring("word", 1, last).alias("key")
        hot = scratch.save(words.groupBy(key).count().filter(F.col("count") > group).select("key"), f"hot{last}")
        keyed = words.withColumn("key", key)
        cold = keyed.join(hot, "key", "left_anti")
        found.append(scratch.save(accepted(cold, last, tasks, group), f"accepted{last}"))
        if hot.isEmpty():
            break
        words = scratch.save(keyed.join(hot, "key", "left_semi").select("id", "word"), f"words{last}")
        first, last = last, 2 * last
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO,
                      min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of all texts.

    Eager: the vocabulary and the pairs are written to the shared folder.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.save(vocabulary(docs, id_col, text_col, min_letters, min_count)
                         .withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = scratch.save(near_pairs(words.select("id", "word"), scratch, group=group), "pairs")
    links = pairs.union(pairs.select("b", "a")).toDF("id", "near")
    seen = (links.join(words.select(F.col("id").alias("near"), F.col("word").alias("w"), F.col("n").alias("m")), "near")
            .groupBy("id").agg(F.count(F.lit(1)).alias("n_near"),
                               F.min(F.struct((-F.col("m")).alias("m"), "w", "near")).alias("best")))
    better = F.coalesce(-F.col("best.m") >= F.col("n") * ratio, F.lit(False))
    judged = scratch.save(words.join(seen, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(better, F.col("best.w")).alias("form"), F.when(better, -F.col("best.m")).alias("form_n"),
        F.when(better, F.col("best.near")).alias("up")), "judged")
    roots = scratch.save(judged.filter("up is not null").select("id", "up"), "roots")
    # each step multiplies n by ``ratio``, so a chain has few steps, and every round doubles what is followed
    most = judged.agg(F.max("n")).first()[0] or 1
    chain = max(1, math.floor(math.log(most / min_count, ratio) + 1e-9)) if most > min_count and ratio > 1 else 1
    for _ in range(math.ceil(math.log2(chain)) if ratio > 1 else 0):
        onward = roots.select(F.col("id").alias("up"), F.col("up").alias("onward"))
        roots = scratch.save(roots.join(onward, "up", "left").select("id", F.coalesce("onward", "up").alias("up")), "roots")
    named = roots.join(judged.select(F.col("id").alias("up"), F.col("word").alias("root")), "up").select("id", "root")
    return (judged.join(named, "id", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
