"""Operator 13: hard negatives by best-first search of an STR-packed R-tree.

Vectors become whole numbers, so scores are exact integer inner products. The
tree is packed by sort-tile-recursive: quantiles of the first coordinate cut the
rows into slabs, quantiles of the second cut each slab into parts of about
``PART`` rows, and a part is cut on by its widest coordinates into pages of
``PAGE`` rows with their minimum bounding boxes. Pages are rows of a table, the
index; equal coordinates are told apart by a hash of the row, so that copies of
one vector spread over parts like any others.

A box gives, coordinate by coordinate, an interval of a query's inner product
with anything in it. A search keeps a queue of boxes by the top of that
interval and opens the best first; boxes outside all score windows, or with a top
strictly below the kth score found, are never opened.

Two rounds make the queue's first box the query's own part: there it finds k
rows, whose kth score is the floor with which it visits the other parts, in
blocks of ``QUERIES`` queries. Ties at the kth score are kept until the last
ranking, so the result is exact.

Defined results: rows with a null label or vector, or a null or non-finite
component take no part, nor do those whose whole numbers are so large that an
inner product could leave 64 bits; vectors are compared with those of their own
length; a row without an id is no anchor and comes after the others of its score;
rows equal in id, label and vector count once, rows that share an id but
differ are rows of their own, in order of label, then hash; only the named columns are
read; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.tables import Scratch
from flowspark.llm.workers import import_path, map_arrow

SCALE, EVERY, K = 256, 100, 5       # fixed values: the contract's scale, anchors and ranks
LOW, HIGH, WHOLE = 80, 100, 100     # fixed values: its score window, in hundredths of the positive's score
PART, PAGE, FAN, QUERIES = 1 << 13, 1 << 8, 8, 1 << 10
LEAST = -(1 << 62)                  # below every score

PAGES = ("dim int, part bigint, page int, lo array<int>, hi array<int>, ids array<bigint>, named array<boolean>, "
         "labels array<bigint>, keys array<bigint>, vecs array<int>")
FOUND = "anchor bigint, w int, score bigint, id bigint, label bigint, key bigint"


# --- rows and pages

def whole_rows(df: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, label, key, dim, k0, k1, vec) of the rows that take part; ``k0`` and ``k1`` order ties by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 2048) for k in range(0, whole.num_rows, 2048)):
                vec = batch.column("vec")
                lengths = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = vec.flatten()
                values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component reads as NaN
                begin = np.cumsum(lengths) - lengths
                row = np.repeat(np.arange(len(lengths)), lengths)
                bound = np.minimum(2.0 ** 31 - 1, np.sqrt(2.0 ** 62 / np.maximum(1, lengths)))
                with np.errstate(invalid="ignore", over="ignore"):
                    number = np.floor(scale * values)
                    bad = ~(np.abs(number) < bound[row])
                ok = np.bincount(row[bad], minlength=len(lengths)) == 0
                number = np.where(bad, 0, number).astype(np.int32)
                key = batch.column("key").to_numpy()
                out = [batch.column("id"), batch.column("label"), batch.column("key"), pa.array(lengths.astype(np.int32))]
                for place, shift in ((0, 11), (1, 8)):
                    at = np.minimum(begin + place, max(0, len(number) - 1))
                    first = np.where(lengths > place, number[at] if len(number) else 0, 0)
                    tie = ((key.view(np.uint64) << np.uint64(11 - shift)) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
                    out.append(pa.array(first + tie))
                offsets = pa.array(np.append(begin, len(number)).astype(np.int32))
                out.append(pa.ListArray.from_arrays(offsets, pa.array(number)))
                yield pa.RecordBatch.from_arrays(out, ["id", "label", "key", "dim", "k0", "k1", "vec"]).filter(pa.array(ok))

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                     F.col(vec_col).alias("vec")).filter("label is not null and vec is not null")
    return map_arrow(rows.withColumn("key", F.xxhash64("id", "label", "vec")), run,
                     "id bigint, label bigint, key bigint, dim int, k0 double, k1 double, vec array<int>")


def _quantiles(n: int) -> list[float]:
    return [k / n for k in range(1, n)]


def parts_of(rows: DataFrame, n: int, part: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """``rows`` with their ``part`` and the number of parts: slabs of the first coordinate, cut by the second."""
    parts = max(1, math.ceil(n / part))
    slabs = math.ceil(math.sqrt(parts))
    tiles = math.ceil(parts / slabs)
    exact = max(10000, 100 * slabs)  # quantiles are off by a hundredth of a slab at most
    slab, tile = F.lit(0), F.lit(0)
    if slabs > 1:
        cuts = rows.agg(F.percentile_approx("k0", _quantiles(slabs), exact)).first()[0]
        slab = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("k0")))
    rows = rows.withColumn("slab", slab)
    if tiles > 1:
        cuts = scratch.save(rows.groupBy("slab").agg(F.percentile_approx("k1", _quantiles(tiles), exact).alias("cuts")),
                            "cuts")
        rows = rows.join(cuts, "slab")
        tile = F.size(F.filter("cuts", lambda c: c < F.col("k1")))
    part_id = (F.col("slab") * tiles + tile).cast("bigint")
    return rows.select("id", "label", "key", "dim", part_id.alias("part"), "vec"), slabs * tiles


def _tiles(vecs: np.ndarray, at: np.ndarray, page: int, levels: int) -> Iterator[np.ndarray]:
    """Rows of each page: sorted and cut by the widest coordinate, then within each slab again."""
    pages = math.ceil(len(at) / page)
    if pages <= 1 or not vecs.shape[1]:
        yield from (at[k:k + page] for k in range(0, len(at), page))
        return
    spread = vecs[at].max(axis=0).astype(np.int64) - vecs[at].min(axis=0)
    at = at[np.argsort(vecs[at, int(spread.argmax())], kind="stable")]
    slabs = math.ceil(pages ** (1 / levels)) if levels > 1 else pages
    size = math.ceil(pages / slabs) * page
    for k in range(0, len(at), size):
        yield from _tiles(vecs, at[k:k + size], page, max(1, levels - 1)) if levels > 1 else iter([at[k:k + size]])


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows), kind))


def pack(rows: DataFrame, page: int) -> DataFrame:
    """The index: a row per page of every part."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        keys, first = np.unique(t.column("key").to_numpy(), return_index=True)  # equal rows count once
        t = t.take(pa.array(first)).combine_chunks()
        dim = t.column("dim")[0].as_py()
        vecs = t.column("vec").chunk(0).flatten().to_numpy().reshape(len(t), dim)
        named = t.column("id").is_valid().to_numpy()
        ids = t.column("id").fill_null(0).to_numpy()
        labels = t.column("label").to_numpy()
        pages = list(_tiles(vecs, np.arange(len(t)), page, 3))
        n = len(pages)
        lo, hi = [vecs[p].min(axis=0) for p in pages], [vecs[p].max(axis=0) for p in pages]
        return pa.table([
            pa.array([dim] * n, pa.int32()), pa.array([t.column("part")[0].as_py()] * n, pa.int64()),
            pa.array(range(n), pa.int32()), _lists(lo, pa.int32()), _lists(hi, pa.int32()),
            _lists([ids[p] for p in pages], pa.int64()), _lists([named[p] for p in pages], pa.bool_()),
            _lists([labels[p] for p in pages], pa.int64()), _lists([keys[p] for p in pages], pa.int64()),
            _lists([vecs[p].ravel() for p in pages], pa.int32())],
            names=[c.split()[0] for c in PAGES.split(", ")])

    import_path(rows.sparkSession)
    return rows.groupBy("dim", "part").applyInArrow(run, PAGES)


def anchors_of(pages: DataFrame, every: int) -> DataFrame:
    """(anchor, id, label, dim, home, vec) of the rows whose id ``every`` divides; ``anchor`` is the row's hash."""
    each = pages.select("dim", F.col("part").alias("home"), "vecs", F.posexplode(F.arrays_zip("ids", "named", "labels", "keys")))
    ours = each.filter((F.col("col.named")) & (F.col("col.ids") % every == 0))
    return ours.select(F.col("col.keys").alias("anchor"), F.col("col.ids").alias("id"), F.col("col.labels").alias("label"),
                       "dim", "home", F.slice("vecs", F.col("pos") * F.col("dim") + 1, F.col("dim")).alias("vec"))


# --- search

class Tree:
    """The pages of one part under boxes of ``FAN`` boxes each, up to one root."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks().sort_by("page").combine_chunks()
        flat = lambda c: t.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False)
        n, dim = len(t), t.column("dim")[0].as_py()
        self.ids, self.named, self.labels, self.keys = (flat(c) for c in ("ids", "named", "labels", "keys"))
        sizes = t.column("ids").chunk(0).value_lengths().to_numpy().astype(np.int64)
        self.ends = np.cumsum(sizes)
        self.vecs = flat("vecs").reshape(len(self.ids), dim)
        lo, hi = flat("lo").reshape(n, dim), flat("hi").reshape(n, dim)
        self.children: list[range] = [range(0)] * n
        begin, boxes_lo, boxes_hi = 0, [lo], [hi]
        while len(lo) > 1:
            heads = np.arange(0, len(lo), FAN)
            self.children += [range(begin + h, begin + min(h + FAN, len(lo))) for h in heads]
            begin += len(lo)
            lo, hi = np.minimum.reduceat(lo, heads), np.maximum.reduceat(hi, heads)
            boxes_lo.append(lo)
            boxes_hi.append(hi)
        self.leaves, self.lo, self.hi = n, np.concatenate(boxes_lo), np.concatenate(boxes_hi)

    def exact(self, queries: np.ndarray) -> type:
        """float64 where every sum is a whole number below 2**53, else 64-bit integers."""
        most = float(np.abs(queries).max(initial=0)) * float(max(np.abs(self.lo).max(initial=0), np.abs(self.hi).max(initial=0)))
        return np.float64 if most * max(1, queries.shape[1]) < 2.0 ** 53 else np.int64

    def intervals(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of every query with anything in every box."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        lo, hi = self.lo.T.astype(queries.dtype), self.hi.T.astype(queries.dtype)
        return up @ lo + down @ hi, up @ hi + down @ lo

    def search(self, vec: np.ndarray, rows: np.ndarray, least: list, most: list, ours: np.ndarray,
               lows: list[int], highs: list[int], k: int) -> list[list[tuple]]:
        """For each score window the best ``k`` rows among ``ours``: (-score, unnamed, id, label, key)."""
        found: list[list[tuple]] = [[] for _ in lows]
        floor = list(lows)
        open_ = [w for w in range(len(lows)) if lows[w] <= highs[w]]
        root = len(most) - 1
        queue = [(-most[root], root)]
        while queue and open_:
            top, box = heapq.heappop(queue)
            if -top < min(floor[w] for w in open_):
                break  # every box that is left lies lower still
            if not any(-top >= floor[w] and least[box] <= highs[w] for w in open_):
                continue
            if box >= self.leaves:
                for child in self.children[box]:
                    if any(most[child] >= floor[w] and least[child] <= highs[w] for w in open_):
                        heapq.heappush(queue, (-most[child], child))
                continue
            begin, end = (self.ends[box - 1] if box else 0), self.ends[box]
            score = rows[begin:end] @ vec
            in_any = ours[begin:end] & (score >= min(floor[w] for w in open_)) & (score <= max(highs[w] for w in open_))
            at = np.flatnonzero(in_any)
            if not len(at):
                continue
            score, at = score[at], at + begin
            for w in open_:
                hit = np.flatnonzero((score >= floor[w]) & (score <= highs[w]))
                if not len(hit):
                    continue
                if len(hit) > k:  # nothing below the kth of these can be among the best
                    kth = np.partition(score[hit], len(hit) - k)[len(hit) - k]
                    hit = hit[score[hit] >= kth]
                r = at[hit]
                found[w] += zip((-score[hit]).tolist(), (~self.named[r]).tolist(), self.ids[r].tolist(),
                                self.labels[r].tolist(), self.keys[r].tolist())
                if len(found[w]) >= k:
                    found[w].sort()
                    del found[w][k:]
                    floor[w] = -found[w][-1][0]
        return found


def _searcher(same: bool, k: int):
    """Function of a part's pages and the queries that visit it: rows as in ``FOUND``."""

    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(pages) and len(queries):
            tree = Tree(pages)
            queries = queries.combine_chunks()
            vecs = queries.column("vec").chunk(0).flatten().to_numpy().reshape(len(queries), -1)
            kind = tree.exact(vecs)
            vecs, rows = vecs.astype(kind), tree.vecs.astype(kind)
            least, most = tree.intervals(vecs)
            masks = {}
            for q, (anchor, label, lows, highs) in enumerate(zip(*(
                    queries.column(c).to_pylist() for c in ("anchor", "label", "lows", "highs")))):
                if label not in masks:
                    masks[label] = (tree.labels == label) == same
                ours = masks[label]
                if same:
                    ours = ours & (tree.keys != anchor)
                for w, best in enumerate(tree.search(vecs[q], rows, least[q].tolist(), most[q].tolist(), ours,
                                                     lows, highs, k)):
                    out += [(anchor, w, int(-s), None if no else i, label_, key) for s, no, i, label_, key in best]
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)

    return run


def search(pages: DataFrame, queries: DataFrame, parts: int, same: bool, k: int, scratch: Scratch,
           block: int) -> DataFrame:
    """``FOUND`` rows that hold each query window's best ``k`` (and a few more): own part first, then the others.

    ``queries``: (anchor, label, dim, home, vec, lows, highs).
    """
    import_path(pages.sparkSession)
    run = _searcher(same, k)

    def visit(pages: DataFrame, queries: DataFrame, keys: list[str], tasks: int) -> DataFrame:
        left = pages.repartition(tasks, *keys).groupBy(*keys)
        return left.cogroup(queries.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, FOUND)

    home = scratch.save(visit(pages, queries.withColumn("part", F.col("home")), ["dim", "part"], parts), "home")
    if parts == 1:
        return home
    # k rows of a window in the own part make their kth score its floor everywhere else
    floors = (home.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
              .filter(F.col("n") >= k).groupBy("anchor")
              .agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("floors")))
    raised = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("floors", w.cast("int")), low)))
    blocks = max(1, math.ceil(queries.count() / block))
    away = (queries.join(floors, "anchor", "left").withColumn("lows", F.when(F.col("floors").isNull(), F.col("lows")).otherwise(raised))
            .withColumn("block", F.pmod(F.hash("anchor"), F.lit(blocks)))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
            .filter("part <> home").drop("floors"))
    sent = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return home.union(scratch.save(visit(sent, away, ["dim", "part", "block"], parts * min(blocks, 64)), "away"))


def best(found: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    """The first ``k`` of each group by score, id, label and hash, numbered from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "label", "key")
    return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def _floor_div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("bigint")


def hard_negatives(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
                   k_positive: int = K, k_negative: int = K, every: int = EVERY, scale: int = SCALE,
                   low: int = LOW, high: int = HIGH, whole: int = WHOLE,
                   part: int = PART, page: int = PAGE, block: int = QUERIES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Eager: rows, pages and both searches are written to the shared folder.
    A negative's score times ``whole`` lies between ``low`` and ``high`` times its positive's score.
    """
    scratch = Scratch(df.sparkSession, "hard_negatives")
    rows = scratch.save(whole_rows(df, id_col, label_col, vec_col, scale), "rows")
    placed, parts = parts_of(rows, rows.count(), part, scratch)
    pages = scratch.save(pack(placed, page), "pages")
    anchors = scratch.save(anchors_of(pages, every), "anchors")

    wide = anchors.withColumns({"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(-LEAST))})
    positives = scratch.save(best(search(pages, wide, parts, True, k_positive, scratch, block), ["anchor"], k_positive, "w")
                             .select("anchor", (F.col("w") - 1).alias("w"), F.col("id").alias("positive_id"),
                                     F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(20,0)")
    windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(
        "w", (-_floor_div(score * -low, whole)).alias("low"), _floor_div(score * high, whole).alias("high")))).alias("x"))
    narrow = anchors.join(windows, "anchor").withColumns({"lows": F.col("x.low"), "highs": F.col("x.high")}).drop("x")
    negatives = best(search(pages, narrow, parts, False, k_negative, scratch, block), ["anchor", "w"], k_negative, "rank")
    return (negatives.join(positives, ["anchor", "w"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
