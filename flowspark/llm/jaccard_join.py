"""Operator 8: n-gram Jaccard join with PartEnum signatures.

A document's set is its distinct 4-word shingles, as 64-bit hashes. Documents
of equal sets are one node. Sets whose Jaccard similarity reaches the threshold
differ in at most K features, K following from their sizes, so:

* sizes are cut into bands; an instance serves the pairs within a band and
  those with the band below, whose larger sets enter both instances;
* each instance cuts the feature domain into P > K parts by hash. Two similar
  sets differ in at most K parts, hence agree in P - K whole parts;
* a set has one signature for a part: the part and the features in it. A set
  may leave out P - K - 1 of its parts, in any order that depends on the parts'
  contents alone: a similar pair agrees in more parts than either leaves out, so
  the part that comes last in that order stays with both. First the weakest parts go
  (those with the fewest features, which unrelated sets share), then, once all
  signatures are counted, the ``common_parts`` most frequent ones (those inside
  passages that many documents hold). That number is the instance's, the same for
  sets of all sizes: the first cut leaves a similar pair one common part more than
  the second takes from either, so no similar pair is lost.

Nodes that share a signature are compared on their whole sets. A bucket is
never expanded into all its pairs: first each node is compared with the least
node it shares a signature with; then only buckets whose nodes are not yet in
one component go on, where some (``PIVOTS``) nodes outside the bucket's largest
component are compared with the other components' nodes and leave the bucket,
until each bucket is one component. That finds every link that joins two
components. Before sets are compared, sketches are: each feature flips one of
1,024 bits, so the sketches of two sets differ in at most as many bits as the
sets do in features, and a pair whose sketches differ in more than K is no link.

Shuffles carry 8-byte signatures and nodes; sets travel only for nodes that
share a signature (a fixed-size bit table says which, a join makes it exact).
A signature or pivot that a third of all rows hold is counted with partial
sums and joined by sort-merge, which Spark splits when it is skewed.

Defined results: null text or no words is the empty set, linked with nothing;
fewer than four words make one shingle of the sequence; repeated rows are equal
sets; rows with the same id but other texts count as linked; a null id is
never a component's name: it gets the least id of its set's component, or null;
only id and text columns are read, so others may have any name; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.tables import Scratch, components, key_filter, slots, unpack
from flowspark.llm.textbytes import BLANK, LOWER, mix, prefix_hashes, slices, span_hashes, window_hashes, word_bounds
from flowspark.llm.workers import map_arrow

SHINGLE = 4
SIMILAR = (85, 100)     # intersection / union
BAND_STEPS = 3          # a band spans this many factors of 1 / similarity
SLACK = 1.25            # parts for each that a similar pair can differ in
PIVOTS = (2, 16, 128, 512)  # of a bucket in the first rounds and all later ones: few nodes connect most of a group
SKETCH = 16              # words of 64 bits in a set's parity sketch


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    starts, ends, bounds = word_bounds(data, offsets, ~BLANK)
    words = span_hashes(prefix_hashes(LOWER[data]), starts, ends)
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    text_of = np.repeat(np.arange(n), sizes)
    hashes = window_hashes(words, k)
    at = np.flatnonzero(text_of[:len(hashes)] == text_of[k - 1:]) if len(hashes) else np.zeros(0, np.int64)
    features, owners = [hashes[at]], [text_of[at]]
    for c in range(1, k):
        short = np.flatnonzero(sizes == c)
        if len(short):
            features.append(window_hashes(words, c)[bounds[short]] ^ np.uint64(c))
            owners.append(short)
    feature, owner = np.concatenate(features), np.concatenate(owners)
    order = np.argsort(feature)
    small = owner[order].astype(np.uint16 if n < 1 << 16 else np.uint32)
    order = order[np.argsort(small, kind="stable")]
    feature, owner = feature[order], owner[order]
    new = np.ones(len(feature), bool)
    new[1:] = (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])
    return feature[new], np.searchsorted(owner[new], np.arange(n + 1))


def set_keys(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit key of each set, whatever the features' order."""
    total = np.zeros(len(features) + 1, np.uint64)
    np.cumsum(mix(features + np.uint64(0xA5A5)), out=total[1:])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def band_edges(largest: int, similar: tuple[int, int] = SIMILAR) -> list[int]:
    """Least size of each band, one band past ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * (similar[1] / similar[0]) ** BAND_STEPS)))
    return edges + [max(edges[-1] + 1, int(edges[-1] * (similar[1] / similar[0]) ** BAND_STEPS))]


def common_parts(most: np.ndarray) -> np.ndarray:
    """Signatures that each set of an instance can leave out for being frequent; ``signatures`` gives it as many
    more. ``most`` is the instance's largest difference: both sets of a pair must leave out equally many."""
    return 2 + (most + 1) // 10


def signatures(features: np.ndarray, bounds: np.ndarray, similar: tuple[int, int] = SIMILAR
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, spare) of all sets, as arrays. A set's signatures come in one or two
    instances; ``spare`` is twice the number of an instance's signatures that the set may
    leave out, plus 1 in its second instance."""
    num, den = similar
    sizes = np.diff(bounds)
    edges = np.array(band_edges(int(sizes.max(initial=0)), similar))
    band = np.searchsorted(edges, sizes, "right") - 1
    sigs, owners, spares = [], [], []
    for shift in (0, 1):
        top = edges[band + 1] - 1                      # largest size in the set's own band
        partner = sizes * den // num                   # largest size of a similar set
        if shift == 0:
            who = np.flatnonzero(sizes > 0)
            partner = np.minimum(partner, top)
        else:                                          # only sets that a set of the next band can be similar to
            who = np.flatnonzero((sizes > 0) & (partner > top))
        if not len(who):
            continue
        instance = band[who] + shift
        differ = (den - num) * (sizes[who] + partner[who]) // (den + num)
        most = (den - num) * 2 * (edges[instance + 1] - 1) // (den + num)
        parts = np.ceil(SLACK * (most + 1)).astype(np.int64) + common_parts(most)
        counts = sizes[who]
        feature = features[np.repeat(bounds[who], counts) + np.arange(counts.sum())
                           - np.repeat(np.cumsum(counts) - counts, counts)]
        base = np.cumsum(parts) - parts
        part = ((mix(feature + np.uint64(7)) >> np.uint64(32))
                * np.repeat(parts, counts).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        cell = np.repeat(base, counts) + part
        total = int(parts.sum())
        held = np.bincount(cell, minlength=total)
        content = np.zeros(total, np.uint64)
        np.add.at(content, cell, mix(feature + np.uint64(99)))
        owner = np.repeat(np.arange(len(who)), parts)
        nth = np.arange(total) - base[owner]
        sig = mix(content + mix((np.repeat(instance, parts) << 32 | nth).astype(np.uint64)) + held.astype(np.uint64))
        order = np.lexsort((sig, -held, owner))
        spare = common_parts(most)
        keep = order[nth <= (differ + spare)[owner]]   # order keeps owners together, so nth is the rank there
        sigs.append(sig[keep])
        owners.append(who[owner[keep]])
        spares.append((spare * 2 + shift)[owner[keep]])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners), np.concatenate(spares)


def sketches(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity sketch of each set: SKETCH rows of 64-bit words, a column a set."""
    bits = SKETCH * 64
    cell = (mix(features + np.uint64(5)) % np.uint64(bits)).astype(np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    odd = (np.bincount(owner * bits + cell, minlength=(len(bounds) - 1) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.int64).T


WORDS = [f"s{k}" for k in range(SKETCH)]


def _document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, h, n, node) of every document; h is the hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, data in slices(batch, "t"):
                features, bounds = shingle_sets(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("i"), rows.column("h"), pa.array(np.diff(bounds)),
                     pa.array(set_keys(features, bounds).view(np.int64))], ["i", "h", "n", "node"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h")), run,
                     f"i {kind}, h bigint, n bigint, node bigint")


def _signature_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """(sig, node, spare); equal sets of a slice give their rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, offsets, data in slices(batch, "t"):
                features, bounds = shingle_sets(data, offsets)
                keys = set_keys(features, bounds)
                sigs, owner, spare = signatures(features, bounds)
                first = np.zeros(len(keys), bool)
                first[np.unique(keys, return_index=True)[1]] = True
                sigs, spare, owner = (x[first[owner]] for x in (sigs, spare, owner))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sigs.view(np.int64)), pa.array(keys[owner].view(np.int64)), pa.array(spare.astype(np.int32))],
                    ["sig", "node", "spare"])

    return map_arrow(docs.select(F.col(text_col).alias("t")), run, "sig bigint, node bigint, spare int")


def _sets_of(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, n, sketch words, features binary) of the nodes in ``nodes``, once each."""
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = unpack(sent.value)
        for batch in batches:
            for _, offsets, data in slices(batch, "t"):
                features, bounds = shingle_sets(data, offsets)
                keys, first = np.unique(set_keys(features, bounds), return_index=True)
                keep = bits[slots(keys)] & (np.diff(bounds)[first] > 0)
                sets = [features[bounds[i]:bounds[i + 1]] for i in first[keep]]
                sizes = np.array([len(x) for x in sets], np.int64)
                words = sketches(np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(sizes)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[keep].view(np.int64)), pa.array(sizes), *(pa.array(np.ascontiguousarray(w)) for w in words),
                     pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "n", *WORDS, "features"])

    found = map_arrow(docs.select(F.col(text_col).alias("t")), run,
                      f"node bigint, n bigint, {', '.join(f'{w} bigint' for w in WORDS)}, features binary")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def similar_pairs(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (x, y) in enumerate(zip(b.column("fa"), b.column("fb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) * similar[1] < max(len(x), len(y)) * similar[0]:
                    continue
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[k] = similar[1] * common >= similar[0] * (len(both) - common)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("features").alias("fa")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("features").alias("fb")), "b")
    return map_arrow(with_b.select("a", "b", "fa", "fb"), run, "a bigint, b bigint")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, node, label) with each node's present component."""
    return (rows.select("sig", "node").join(labels, "node", "left")
            .select("sig", "node", F.coalesce("label", "node").alias("label")))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document. Eager: its rounds write tables to the shared folder."""
    return document_components(docs, id_col, text_col).select(id_col, "n_shingles", "component_id")


def document_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``similarity_components`` with ``text_hash`` (Spark's xxhash64 of the text) and ``component``, a key that
    rows with null ids have as well; it is null for empty sets, which are linked with nothing."""
    scratch = Scratch(docs.sparkSession, "jaccard_join")
    members = scratch.save(_document_sets(docs, id_col, text_col), "members")
    rows = scratch.save(_signature_rows(docs, text_col), "signatures")
    shared = scratch.save(rows.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    # A node leaves out its most frequent signatures, as many as each of its instances spares.
    own = Window.partitionBy("node", F.col("spare") % 2).orderBy(F.desc("n"), "sig")  # at most a document's parts
    buckets = scratch.save(rows.join(shared, "sig").dropDuplicates(["sig", "node"])
                           .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") > F.shiftright("spare", 1))
                           .select("sig", "node"), "buckets")

    least = buckets.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("last")).filter("a < last")
    pairs = scratch.save(buckets.join(least.select("sig", "a"), "sig").filter("node > a")
                         .groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    involved = buckets.join(least.select("sig"), "sig", "left_semi").select("node").distinct()
    sets = scratch.save(_sets_of(docs, text_col, involved), "sets")
    held = members.filter((F.col("n") > 0) & F.col("i").isNotNull()).select("i", "node")
    ids = scratch.save(held.groupBy("i").agg(F.min("node").alias("a"), F.max("node").alias("last"))
                       .filter("a < last").select("i", "a"), "ids")  # ids of several sets, each linked with the least
    same_id = held.join(ids, "i").filter("node > a").select("a", F.col("node").alias("b")).distinct()
    edges = scratch.save(similar_pairs(pairs, sets).union(same_id), "edges")
    labels = components(edges, edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0), scratch)
    tested, rows, turn = pairs, _labelled(buckets, labels), 0
    while True:
        major = scratch.save(rows.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("n"))
                             .groupBy("sig").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("k"))
                             .filter("k > 1").select("sig", F.col("most.label").alias("major")), "major")
        rows = scratch.save(rows.join(major, "sig").join(sets.drop("features"), "node"), "mixed")
        if rows.isEmpty():
            break
        # Once the nodes outside a bucket's largest component have been pivots, the bucket is spent.
        slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PIVOTS[min(turn, len(PIVOTS) - 1)]))
        turn += 1
        pivots = scratch.save(rows.filter("label <> major").groupBy("sig", slot.alias("slot"))
                              .agg(F.min(F.struct("node", "label", "n", *WORDS)).alias("p"))
                              .select("sig", F.col("p.node").alias("p"), F.col("p.label").alias("pl"),
                                      F.col("p.n").alias("pn"), *[F.col(f"p.{w}").alias(f"p{w}") for w in WORDS]), "pivots")
        bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(w).bitwiseXOR(F.col(f"p{w}"))) for w in WORDS])
        num, den = SIMILAR
        close = bits * (den + num) <= (F.col("n") + F.col("pn")) * (den - num)
        right = pivots.withColumnRenamed("sig", "psig")
        met = (rows.join(right, (F.col("sig") == F.col("psig")) & (F.col("label") != F.col("pl")) & close)
               .select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct())
        fresh = scratch.save(met.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = scratch.save(tested.union(fresh), "tested")
        found = scratch.save(similar_pairs(fresh, sets), "found")
        rows = rows.select("sig", "node", "label").join(
            pivots.select("sig", F.col("p").alias("node")), ["sig", "node"], "left_anti")
        if not found.isEmpty():
            edges = scratch.save(edges.union(found), "edges")
            labels = components(edges, labels, scratch)
            rows = _labelled(rows, labels)
        rows = scratch.save(rows, "rest")

    named = (members.filter("n > 0").join(labels, "node", "left")
             .select("i", "h", "n", F.coalesce("label", "node").alias("label")))
    names = scratch.save(named.groupBy("label").agg(F.min("i").alias("component_id")), "names")
    found = named.join(names, "label").select("i", "n", "component_id", "h", "label")
    alone = members.filter("n = 0").select("i", "n", F.col("i").alias("component_id"), "h", F.lit(None).cast("bigint").alias("label"))
    return found.union(alone).toDF(id_col, "n_shingles", "component_id", "text_hash", "component")
