"""SimHash near-duplicates: vantage-point trees over 64-bit fingerprints, exact within a Hamming radius.

Fingerprints are partitioned by their Hamming distances to vantage points, one for each section of 16 bits, in
bands. By the triangle inequality the distances of two fingerprints to a section's vantage point differ by what they
differ in that section at most, so those of two within the radius differ by the radius at most over all sections
together. A fingerprint visits only the shards whose bands it can reach within that sum; every other branch is
pruned, and the shards to visit are 33 (bands of three) or 41 (bands of one) at most, whatever the corpus. Each shard
goes on with a vantage-point tree of its own, down to small leaves that are compared pair by pair, and returns
a spanning forest of its links, never all pairs. Minimum labels with pointer jumping then join the forests into
components.

Edge cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows share
their fingerprint; null doc_ids never name a component unless it has no other; an empty table gives an
empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Sections of a fingerprint, each with a vantage point of its own, and bits in each.
SECTIONS, BITS = 4, 16
#: Widths of the bands of distances, and about how many shards they make of evenly spread bits.
WIDTHS = {3: 58, 1: 4700}
#: Fingerprints that a task holds of a shard at most; larger shards are held in blocks.
SHARD = 1 << 20
#: One in so many of all fingerprints makes a block too, so that a crowded shard doesn't weigh on one task; a share of
#: all, so that copies don't grow faster than the fingerprints.
CROWDED = 16
#: Fingerprints from which vantage points are chosen.
SAMPLE = 1024
#: A block's visitors are dealt out so that about as many as it holds, or so many at least, meet a copy of it.
VISITORS = 2_000
#: Pairs that a leaf compares directly, in one block.
LEAF = 1 << 20


def hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles in order, repeats included; a text of fewer words is one shingle, one without words has none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not w:
        return np.zeros(0, np.uint64)
    joined, ends, at = b" ".join(w), [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    h, n = xxhash.xxh64_intdigest, max(1, len(w) - width + 1)
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[:n], ends[min(width, len(w)) - 1 :])), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):  # very long texts stay within a block's memory
        bits = np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    return majority(hashes(text, width, seed))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def vantage_points(fps: DataFrame, width: int) -> list[int]:
    """For each section the one of SAMPLE fingerprints to which their distances spread over the bands most evenly."""
    rows = fps.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    s = np.array([r.fp for r in rows] or [0], np.int64).view(np.uint64)
    chosen = []
    for i in range(SECTIONS):
        part = s >> np.uint64(BITS * i) & np.uint64((1 << BITS) - 1)
        bands = np.bitwise_count(part[:, None] ^ part[None, :]) // width
        share = np.array([(bands == b).mean(axis=1) for b in range(BITS // width + 1)])
        chosen.append(int(part[np.argmin((share**2).sum(axis=0))]))
    return chosen


def cells(points: list[int], width: int, radius: int) -> tuple[Column, Column]:
    """The shard of a fingerprint (column fp), and the array of those that it visits: its own and greater ones in reach.

    Of two shards the lesser one's fingerprints visit the greater, so that each pair meets once.
    """
    most = 1 + (radius - 1) // width if radius else 0
    base = BITS // width + 1 + 2 * most  # room for bands that no distance has
    away = [F.bit_count(F.shiftrightunsigned("fp", BITS * i).bitwiseAND((1 << BITS) - 1).bitwiseXOR(v)) for i, v in enumerate(points)]
    own = sum(((F.floor(d / width) + most) * base**i for i, d in enumerate(away)), F.lit(0).cast("long"))
    visits = [own]
    for shift in product(range(-most, most + 1), repeat=SECTIONS):
        by = sum(x * base**i for i, x in enumerate(shift))
        if by > 0 and sum(1 + (abs(x) - 1) * width for x in shift if x) <= radius:
            # Steps from a distance to the nearest one in the band.
            steps = [(d % width + 1 + (-x - 1) * width) if x < 0 else (width - d % width + (x - 1) * width) for d, x in zip(away, shift) if x]
            visits.append(F.when(sum(steps[1:], steps[0]) <= radius, own + by))
    return own, F.array_compact(F.array(*visits))


def leaf_pairs(h: np.ndarray, q: np.ndarray, hi: np.ndarray, qi: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, by a vantage-point tree that prunes by the triangle inequality."""
    if not len(hi) or not len(qi):
        return
    if len(hi) * len(qi) > LEAF:
        tries = h[hi[np.linspace(0, len(hi) - 1, 7).astype(int)]]
        some = h[hi[:: max(1, len(hi) // 500)]]
        v = max(tries, key=lambda x: np.bitwise_count(some ^ x).std())
        dh, dq = np.bitwise_count(h[hi] ^ v).astype(np.int16), np.bitwise_count(q[qi] ^ v).astype(np.int16)
        rings, sizes = np.unique(dh, return_counts=True)
        if sizes.max() < 0.9 * len(hi):
            oh, oq = np.argsort(dh, kind="stable"), np.argsort(dq, kind="stable")
            sh, sq = dh[oh], dq[oq]
            for r in rings:
                a, b = np.searchsorted(sh, [r, r + 1])
                c, d = np.searchsorted(sq, [r - radius, r + radius + 1])
                yield from leaf_pairs(h, q, hi[oh[a:b]], qi[oq[c:d]], radius)
            return
    step = max(1, LEAF // len(hi))
    for k in range(0, len(qi), step):
        near = np.bitwise_count(h[hi][:, None] ^ q[qi[k : k + step]][None, :]) <= radius
        a, b = np.nonzero(near)
        yield hi[a], qi[k + b]


def spread(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Smallest label of each component, in place."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label[:] = label[label]
        if (before == label).all():
            return


def forest(home: np.ndarray, visit: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest one of its component here) for all that link within a shard."""
    nodes = np.unique(np.concatenate([home, visit]))
    h, q = np.searchsorted(nodes, home), np.searchsorted(nodes, visit)
    label = np.arange(len(nodes))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for a, b in leaf_pairs(home, visit, np.arange(len(home)), np.arange(len(visit)), radius):
        if len(a):
            held.append((h[a], q[b]))
            size += len(a)
        if size > 4_000_000:
            spread(label, *(np.concatenate(x) for x in zip(*held)))
            held, size = [], 0
    if held:
        spread(label, *(np.concatenate(x) for x in zip(*held)))
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): a spanning set of the links between distinct fingerprints (column fp, distinct rows, read more than once)."""
    n = fps.count()
    width = next((w for w, shards in WIDTHS.items() if n <= shards * SHARD), min(WIDTHS))
    own, visited = cells(vantage_points(fps, width), width, radius)
    homes, visits = fps.select("fp", own.alias("cell")), fps.select("fp", F.explode(visited).alias("cell"))
    held = homes.groupBy("cell").agg(F.count(F.lit(1)).alias("held"))
    met = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("met"))
    block = min(SHARD, max(VISITORS, n // CROWDED))
    blocks = F.ceil(F.col("held") / block)
    copies = F.ceil(F.col("met") / F.greatest(F.ceil(F.col("held") / blocks), F.lit(VISITORS)))
    # As many rows as there are bands to the power of SECTIONS, 83,521 at most. Shards that hold nothing get no visitors.
    sizes = F.broadcast(cut(held.join(met, "cell").select("cell", blocks.alias("blocks"), copies.alias("copies"))))
    deal = lambda most: F.pmod(F.xxhash64("fp"), F.col(most))
    each = lambda most: F.explode(F.sequence(F.lit(0).cast("long"), F.col(most) - 1))
    homes = homes.join(sizes, "cell").select("fp", "cell", deal("blocks").alias("block"), each("copies").alias("copy"), F.lit(True).alias("lives"))
    visits = visits.join(sizes, "cell").select("fp", "cell", each("blocks").alias("block"), deal("copies").alias("copy"), F.lit(False).alias("lives"))

    def shard(p: pd.DataFrame) -> pd.DataFrame:
        x, lives = p["fp"].to_numpy().view(np.uint64), p["lives"].to_numpy()
        a, b = forest(x[lives], x[~lives], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return homes.unionByName(visits).groupBy("cell", "block", "copy").applyInPandas(shard, "a long, b long")


def components(edges: DataFrame, rounds: int = 60, settle: bool = True) -> DataFrame:
    """(node, label): the smallest node of each node's component, for the nodes of edges (a, b).

    Minimum labels of neighbours, then pointer jumping; a star or chain halves its depth each round. Without settle
    it ends after the rounds given: nodes of one label are of one component, which may still have several.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(rounds):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("near"))
        low = label.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        low = cut(low)
        jump = low.select(F.col("node").alias("via"), F.col("low").alias("far"))
        new = cut(low.join(jump, F.col("low") == F.col("via"), "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("new")))
        done = settle and new.filter("new <> label").isEmpty()
        label = new.select("node", F.col("new").alias("label"))
        if done:
            return label
    if settle:
        raise RuntimeError("components did not settle")
    return label


def classes(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every document."""
    own = cut(fingerprints(docs))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(distinct, radius))
    lowest = linked.join(distinct, F.col("node") == F.col("fp")).groupBy("label").agg(F.min("least").alias("low"))
    named = linked.join(lowest, "label").select("node", "low")
    # Cut off, so that the last join has exchanges of its own and a fingerprint of very many documents is split.
    of = cut(distinct.join(named, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("low", "least").alias("component_id")))
    return own.join(of, "fp").select("doc_id", "fp", "component_id")
