"""Operator 9: removal of repeated byte strings by column-wise suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts somewhere
else is removed. Inserting whole documents a symbol a round would take as many
passes over the collection as its longest document has bytes, so documents are
first cut into aligned blocks that can share such a string at all:

1. Of each window of ``length`` bytes the gram with the least hash (leftmost if
   tied) is its anchor: equal windows have equal anchors at equal places, and
   a document has an anchor about every ``(length - gram) / 2`` bytes. In a run of a
   short period all grams tie, so grams that have a period of at most ``gram / 2``
   come last, and windows that equal the one a period before are marked on
   the spot and go no further: the first of them stand for the run.
2. Anchors whose gram occurs once are done. For the others the block around
   the anchor is cut out: from the first window start the anchor serves to the
   end of the last. Long texts are handled in pieces that overlap by a window or more.
3. The blocks of one anchor form a collection, aligned at the anchor. From the
   right end to the left, each round inserts one symbol per block: the order of
   the suffixes that start at the column is the former order, stably sorted by
   the new symbol (the column of the collection's Burrows-Wheeler transform),
   and common prefixes grow by one, or restart at the new symbol, from minima
   over the former ones. At a window start, a common prefix of ``length`` or
   more with a neighbour says that the window is repeated.

Blocks come sorted from Spark's shuffle files and are read in turn, a bounded
number at once. An anchor with more than ``group`` blocks is dealt over
several collections by a salt; one of each collection's equal windows
is then compared across them by 128 bits of hash, counted with partial sums. Texts that
occur twice or more are counted first: they are removed whole and enter as one.

Defined results: null text is empty; texts shorter than ``length`` stay whole;
repeated rows are copies of each other; ids are only carried, null or equal or not; only id
and text columns are read, so others may have any name; an empty table gives an
empty table. Overlapping occurrences count, and strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.tables import Scratch, key_filter, slots, unpack
from flowspark.llm.textbytes import SLICE_BYTES, prefix_hashes, slices, span_hashes
from flowspark.llm.workers import map_arrow

LENGTH = 400
GRAM = 200
GROUP = 4096     # blocks of one anchor in one collection
BLOCKS = 8192    # blocks sorted at once, groups kept whole
SEGMENT = 1 << 20        # window starts of a long text whose anchors are found at once
PIECE = SLICE_BYTES      # bytes of a text that blocks are cut from at once
_PLACE_BITS = 30


def short_periods(data: np.ndarray, offsets: np.ndarray, prefix: np.ndarray, length: int, gram: int
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram has a short period, window equals the one a short period before), by place, and the
    (start, end) of the runs whose windows repeat. A short period is at most ``gram / 2``."""
    n, most = len(data), gram // 2
    grams, windows = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (gram - most) // 6)
    at = np.arange(0, max(n - gram + step, 0), step)
    for p in range(1, most + 1) if len(at) else ():
        reach = gram - p - step + 1          # a gram of period p has this many bytes equal to those p on, from a sample
        x = at
        if reach >= 8:
            here, there = (np.ndarray(len(at), np.uint64, data, k, (step,)) for k in (0, p))
            x = at[here == there]
        x = x[span_hashes(prefix, x, x + reach) == span_hashes(prefix, x + p, x + p + reach)]
        if not len(x):
            continue
        # Neighbouring samples are of one run, which ends less than a step before the first and after the last.
        gap = np.flatnonzero(np.diff(x) > step)
        u, v = x[np.append(0, gap + 1)], x[np.append(gap, len(x) - 1)] + reach
        near = np.arange(step)
        left, right = u[:, None] - 1 - near, v[:, None] + near
        same = (left >= 0) & (data[np.maximum(left, 0)] == data[np.maximum(left, 0) + p])
        u = u - np.logical_and.accumulate(same, axis=1).sum(axis=1)
        inside = np.minimum(right, n - p - 1)
        same = (right < n - p) & (data[inside] == data[inside + p])
        v = v + np.logical_and.accumulate(same, axis=1).sum(axis=1)
        # A run ends with its text, where the byte p on is another text's.
        text = np.searchsorted(offsets, u, "right") - 1
        k = np.searchsorted(offsets, v - 1, "right") - text
        text = np.repeat(text - np.cumsum(k) + k, k) + np.arange(k.sum())
        u, v = np.maximum(np.repeat(u, k), offsets[text]), np.minimum(np.repeat(v, k), offsets[text + 1] - p)
        long = v - u >= gram - p
        u, v = u[long], v[long]
        grams[u] += 1
        grams[v - (gram - p) + 1] -= 1
        long = v - u >= length
        u, v = u[long], v[long]
        windows[u + p] += 1
        windows[v - length + p + 1] -= 1
        starts.append(u)
        ends.append(v + p)
    runs = np.unique(np.stack([np.concatenate(starts), np.concatenate(ends)]), axis=1)
    return np.cumsum(grams[:-1]) > 0, np.cumsum(windows[:-1]) > 0, runs[0], runs[1]


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place, first, last, hash): anchors, and the window starts each serves, as offsets in ``data``;
    then (text, start, end) of the runs of a short period whose windows repeat."""
    span = length - gram + 1
    n = len(data) - gram + 1
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - length + 1, 0)
    total = int(starts.sum())
    if not total:
        return (none,) * 8
    at = np.arange(n)
    prefix = prefix_hashes(data)
    grams = span_hashes(prefix, at, at + gram)
    periodic, again, begin, end = short_periods(data, offsets, prefix, length, gram)
    keys = ((grams >> np.uint64(_PLACE_BITS + 1)) << np.uint64(_PLACE_BITS) | at.astype(np.uint64)
            | periodic[:n].astype(np.uint64) << np.uint64(63))
    # Minimum over [s, s + span): the end of one block of ``span`` places and the beginning of the next.
    padded = np.full(-(-(n + span) // span) * span, np.iinfo(np.uint64).max)
    padded[:n] = keys
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    text = np.repeat(np.arange(len(sizes)), starts)
    s = np.arange(total) - np.repeat(np.cumsum(starts) - starts, starts) + offsets[text]
    place = (np.minimum(behind[s], ahead[s + span - 1]) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    text, s, place = (x[~again[s]] for x in (text, s, place))
    new = np.flatnonzero(np.concatenate(
        [[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.append(new[1:], len(s)) - 1
    return (text[new], place[new], s[new], s[last], grams[place[new]].view(np.int64),
            np.searchsorted(offsets, begin, "right") - 1, begin, end)


def _first_of(keys: np.ndarray) -> np.ndarray:
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, k1, k2, place, before, after, end): window starts run from place - before to place - after.
    Rows without an anchor are runs from place to end whose windows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, data in slices(batch, "t", SEGMENT):
                k1, k2 = rows.column("k1").to_numpy(), rows.column("k2").to_numpy()
                first_copy = _first_of(k1 + k2)  # copies within the slice give their anchors once
                for at in range(0, max(len(data) - length, 0) + 1, SEGMENT) if len(offsets) == 2 else (0,):
                    part, bounds = data, offsets
                    if len(offsets) == 2:
                        part = data[at:at + SEGMENT + length - 1]
                        bounds = np.array([0, len(part)])
                    found = anchors_of(part, bounds, length, gram)
                    once = first_copy[found[0]]
                    text, place, first, last, grams = (x[once] for x in found[:5])
                    once = first_copy[found[5]]
                    owner, start, end = (x[once] for x in found[5:])
                    of = np.concatenate([text, owner])
                    blank = np.arange(len(of)) >= len(text)
                    zero = np.zeros(len(owner), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([grams, zero]), mask=blank), pa.array(k1[of]), pa.array(k2[of]),
                         pa.array((np.concatenate([place, start]) - bounds[of] + at).astype(np.int32)),
                         pa.array(np.concatenate([place - first, zero]).astype(np.int16)),
                         pa.array(np.concatenate([place - last, zero]).astype(np.int16)),
                         pa.array((np.concatenate([place, end]) - bounds[of] + at).astype(np.int32), mask=~blank)],
                        ["anchor", "k1", "k2", "place", "before", "after", "end"])

    return map_arrow(texts.select("k1", "k2", "t"), run,
                     "anchor bigint, k1 bigint, k2 int, place int, before smallint, after smallint, end int")


def _block_rows(pieces: DataFrame, length: int) -> DataFrame:
    """Blocks of the places listed with each piece of a text: (anchor, salt, salted, k1, k2, start, before, after, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                rows = batch.slice(at, 32)
                out = []
                for r in rows.to_pylist():
                    piece, begin = r["piece"], r["chunk"] * PIECE
                    for p in r["places"]:
                        start = p["place"] - p["before"]
                        out.append((p["anchor"], p["salt"], p["salted"], r["k1"], r["k2"], start, p["before"],
                                    p["after"], piece[start - begin:p["place"] - p["after"] + length - begin]))
                columns = list(zip(*out)) if out else [[]] * 9
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int16(),
                         pa.int16(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _BLOCK_NAMES)

    return map_arrow(pieces.select("k1", "k2", "chunk", "piece", "places"), run,
                     "anchor bigint, salt int, salted boolean, k1 bigint, k2 int, start int, before smallint, "
                     "after smallint, block binary")


_BLOCK_NAMES = ["anchor", "salt", "salted", "k1", "k2", "start", "before", "after", "block"]


def repeated_starts(group: np.ndarray, before: np.ndarray, after: np.ndarray, flat: np.ndarray, bounds: np.ndarray,
                    length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each block and each j, whether the window at place - before + j has a partner in its group,
    and whether it stands for its group's copies of that window (one of them does).

    Blocks come with equal ``group`` values together; block b holds the bytes
    ``flat[bounds[b]:bounds[b + 1]]``, its anchor ``before[b]`` bytes in.
    """
    m = len(group)
    left, right = int(before.max()), int((np.diff(bounds) - before).max())
    sizes = np.diff(bounds)
    table = np.full((left + right, m), 256, np.int16)   # 256: outside the block, equal to nothing
    owner = np.repeat(np.arange(m), sizes)
    column = left - before[owner] + np.arange(len(flat)) - bounds[:-1][owner]
    table[column, owner] = flat
    found, stands = np.zeros((m, left + 1), bool), np.zeros((m, left + 1), bool)
    order = np.arange(m)
    rank = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1])])).astype(np.int64)  # of the group at each position
    same_group = np.concatenate([[False], rank[1:] == rank[:-1]])
    common = np.zeros(m, np.int32)                      # with the position before, 0 at a group's first
    for c in range(left + right - 1, -1, -1):
        symbol = table[c][order]
        key = rank << 9 | symbol
        if (key[1:] >= key[:-1]).all():
            grown = common + 1
        else:
            by_symbol = np.argsort(symbol, kind="stable")
            small = rank[by_symbol].astype(np.uint16 if m < 1 << 16 else np.int64)
            turn = by_symbol[np.argsort(small, kind="stable")]
            # Between new neighbours stood the positions from one to the other: the least of their prefixes.
            a, b = turn[:-1], turn[1:]
            ahead = b > a
            grown = np.zeros(m, np.int32)
            near = ahead & (b - a == 1)
            grown[1:][near] = common[b[near]] + 1
            far = np.flatnonzero(ahead & (b - a > 1) & (symbol[a] == symbol[b]) & same_group[1:])
            if len(far):
                cuts = np.empty(2 * len(far), np.int64)
                cuts[::2], cuts[1::2] = a[far] + 1, b[far] + 1
                padded = np.append(common, 0)
                grown[1:][far] = np.minimum.reduceat(padded, cuts)[::2] + 1
            order, symbol = order[turn], symbol[turn]
        equal = np.zeros(m, bool)
        equal[1:] = (symbol[1:] == symbol[:-1]) & same_group[1:] & (symbol[1:] < 256)
        common = np.where(equal, grown, 0)
        if c <= left:                                   # a window may start here
            later = common >= length
            hit = later.copy()
            hit[:-1] |= later[1:]
            found[order[hit], left - c] = True          # this many bytes before the anchor
            stands[order[~later], left - c] = True
    j = before[:, None] - np.arange(int((before - after).max()) + 1)[None, :]
    inside = j >= after[:, None]
    at = np.arange(m)[:, None], np.maximum(j, 0)
    return found[at] & inside, stands[at] & inside


def _collection_rows(blocks: DataFrame, length: int, sorted_at_once: int) -> DataFrame:
    """(k1, k2, start, end, w1, w2): repeated ranges, and windows of salted groups still to be compared."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def sort(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        col = {c: rows.column(c).to_numpy() for c in _BLOCK_NAMES[:-1]}
        block = rows.column("block").chunk(0).cast(pa.large_binary())
        bounds = np.frombuffer(block.buffers()[1], np.int64)[block.offset:block.offset + len(block) + 1]
        flat = np.frombuffer(block.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        new = np.concatenate([[True], (col["anchor"][1:] != col["anchor"][:-1]) | (col["salt"][1:] != col["salt"][:-1])])
        before, after = col["before"].astype(np.int64), col["after"].astype(np.int64)
        hit, stands = repeated_starts(np.cumsum(new), before, after, flat, bounds, length)
        edge = np.zeros((hit.shape[0], hit.shape[1] + 2), np.int8)
        edge[:, 1:-1] = hit
        step = np.diff(edge, axis=1)
        b, s = np.nonzero(step == 1)
        e = np.nonzero(step == -1)[1]
        start = col["start"].astype(np.int64)
        out = [(col["k1"][b], col["k2"][b], start[b] + s, start[b] + e - 1 + length, None, None)]
        b, s = np.nonzero(col["salted"][:, None] & stands)
        if len(b):
            prefix, at = prefix_hashes(flat), bounds[b] + s
            out.append((col["k1"][b], col["k2"][b], start[b] + s, start[b] + s + length,
                        span_hashes(prefix, at, at + length // 2).view(np.int64),
                        span_hashes(prefix, at + length // 2, at + length).view(np.int64)))
        batches = [pa.RecordBatch.from_arrays(
            [pa.nulls(len(o[0]), k) if x is None else pa.array(x, k) for x, k in zip(o, kinds)],
            ["k1", "k2", "start", "end", "w1", "w2"]) for o in out]
        return pa.Table.from_batches(batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size <= sorted_at_once:
                continue
            rows = pa.Table.from_batches(held)
            anchor, salt = rows.column("anchor").to_numpy(), rows.column("salt").to_numpy()
            ends = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1  # groups kept whole
            done = 0
            while len(ends) and ends[-1] - done > 0 and size - done > sorted_at_once:
                upto = ends[ends <= done + sorted_at_once]
                upto = int(upto[-1]) if len(upto) and upto[-1] > done else int(ends[ends > done][0]) if (ends > done).any() else None
                if upto is None:
                    break
                yield from sort(rows.slice(done, upto - done)).to_batches()
                done = upto
            held = rows.slice(done).to_batches()
            size -= done
        if size:
            yield from sort(pa.Table.from_batches(held)).to_batches()

    return map_arrow(blocks.select(*_BLOCK_NAMES), run,
                     "k1 bigint, k2 int, start int, end int, w1 bigint, w2 bigint")


def _kept_rows(texts: DataFrame) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept_sha256) of texts with their repeated ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                rows = batch.slice(at, 32)
                out = []
                for r in rows.to_pylist():
                    whole, kept, removed, spans, done = r["t"].encode(), hashlib.sha256(), 0, 0, 0
                    end = -1
                    for s, e in sorted((x["start"], x["end"]) for x in r["ranges"]):
                        if s > end:
                            kept.update(whole[done:s])
                            spans += 1
                            removed += e - s
                        elif e > end:
                            removed += e - end
                        end = done = max(end, e)
                    kept.update(whole[done:])
                    out.append((removed, spans, kept.hexdigest()))
                columns = list(zip(*out)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays(
                    [rows.column("k1"), rows.column("k2"), pa.array(columns[0], pa.int64()),
                     pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                    ["k1", "k2", "n_removed", "n_spans", "kept"])

    return map_arrow(texts.select("k1", "k2", "t", "ranges"), run,
                     "k1 bigint, k2 int, n_removed bigint, n_spans bigint, kept string")


def _passing(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts whose k1 is among the keys, or passes their bit table by chance."""
    sent = texts.sparkSession.sparkContext.broadcast(key_filter(keys, "k1"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpack(sent.value)
        for b in batches:
            yield b.filter(pa.array(bits[slots(b.column("k1").to_numpy())]))

    return map_arrow(texts.select("k1", "k2", "t"), run, "k1 bigint, k2 int, t string")


def _pieces(texts: DataFrame, keys: DataFrame, length: int) -> DataFrame:
    """(k1, k2, chunk, piece) of the texts that ``_passing`` keeps: each piece is followed by the bytes of two windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, data in slices(batch, "t", PIECE):
                chunks = range(-(-len(data) // PIECE)) if len(offsets) == 2 else (0,)
                for c in chunks:
                    piece = (pa.array([data[c * PIECE:(c + 1) * PIECE + 2 * length].tobytes()], pa.binary())
                             if len(offsets) == 2 else rows.column("t").cast(pa.binary()))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("k1"), rows.column("k2"), pa.array(np.full(len(piece), c, np.int32)), piece],
                        ["k1", "k2", "chunk", "piece"])

    return map_arrow(_passing(texts, keys), run, "k1 bigint, k2 int, chunk int, piece binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM, group: int = GROUP, sorted_at_once: int = BLOCKS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed_share, repeated) of every document.

    ``removed_share`` is n_removed by n_bytes (0 for an empty text), ``repeated``
    says that it isn't 0. Eager: its steps write tables to the shared folder.
    """
    scratch = Scratch(docs.sparkSession, "suffix_dedup")
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("t")).select(
        "i", "t", F.xxhash64("t").alias("k1"), F.hash("t").alias("k2"))
    base = scratch.save(texts.select("i", "k1", "k2", F.octet_length("t").cast("bigint").alias("n_bytes"),
                                     F.sha2("t", 256).alias("whole")), "base")
    # Tables that are joined on what they were grouped by are written first: a join of
    # two shuffles can be split where it is skewed, one of a shuffle and an aggregate can't.
    copies = scratch.save(base.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")), "copies")

    long_texts = texts.filter(F.octet_length("t") >= length)
    served = scratch.save(_anchor_rows(long_texts, length, gram), "anchors")
    anchors = served.filter("anchor is not null").drop("end")
    place = F.xxhash64("k1", "k2", "place")
    shared = scratch.save(anchors.groupBy("anchor").agg(F.min(place).alias("x"), F.max(place).alias("y"),
                                                        F.count(F.lit(1)).alias("n"))
                          .filter("x <> y").select("anchor", "n"), "shared")
    salts = F.ceil(F.col("n") / group).cast("int")
    places = scratch.save(
        anchors.join(shared, "anchor")
        .withColumn("salt", F.pmod(F.hash("k1", "k2", "place"), salts)).withColumn("salted", salts > 1)
        .withColumn("chunk", F.floor((F.col("place") - F.col("before")) / PIECE).cast("int"))
        .groupBy("k1", "k2", "chunk").agg(F.collect_set(F.struct("anchor", "salt", "salted", "place", "before", "after"))
                                 .alias("places")), "places")
    once = _pieces(long_texts, places, length).dropDuplicates(["k1", "k2", "chunk"])
    blocks = _block_rows(once.join(places, ["k1", "k2", "chunk"]), length)
    rows = scratch.save(_collection_rows(blocks.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt"),
                                         length, sorted_at_once), "ranges")

    across = rows.filter("w1 is not null")  # a window that stands for copies is in ``ranges`` already
    twice = (across.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2"))
    ranges = (rows.filter("w1 is null").select("k1", "k2", "start", "end")
              .union(served.filter("anchor is null").select("k1", "k2", F.col("place").alias("start"), "end"))
              .union(across.join(twice, ["w1", "w2"]).select("k1", "k2", "start", "end")))
    found = scratch.save(ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
                         .join(copies.filter("copies = 1").drop("copies"), ["k1", "k2"]), "found")
    kept = _kept_rows(_passing(long_texts, found).join(found, ["k1", "k2"]))
    zero = F.lit(0).cast("bigint")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    removed = (base.join(copies, ["k1", "k2"]).join(kept, ["k1", "k2"], "left")
               .select(F.col("i").alias(id_col), "n_bytes",
                       F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
                       F.when(gone, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
                       F.when(gone, F.lit(hashlib.sha256(b"").hexdigest()))
                       .otherwise(F.coalesce("kept", "whole")).alias("kept_sha256")))
    return removed.withColumns({"removed_share": F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes"))
                                .otherwise(F.lit(0.0)), "repeated": F.col("n_removed") > 0})
