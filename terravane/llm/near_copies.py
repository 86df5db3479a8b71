"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 at least, and what such links join.

1. Exact copies are collapsed. Each text gets its SimHash fingerprint and the minima of its shingles' hashes under
   BANDS x ROWS multipliers, from the same hashes. Candidates are texts whose fingerprints are within RADIUS, found by
   the vantage-point trees, and, since texts at 0.8 mostly differ in more bits than any tree of 64-bit fingerprints
   can prune by, texts that share all minima of a band: a pair at similarity s shares one with the probability
   1 - (1 - s ** ROWS) ** BANDS, 0.9999 at 0.8 and more above.
2. Groups of candidates that touch are dealt out whole with their texts, large ones as pairs of blocks. Pairs whose
   minima agree nearly as often as they should are compared by their shingles, unless they are joined already.
3. Of each component of the links that hold, one text stays.

Edge cases: texts without words are copies of each other; fewer words than a shingle are one shingle; rows without
doc_id take part and come last; rows that share a doc_id are told apart by their texts; an empty table gives an
empty result; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, stored
from .simhash import components
from .suffix_dedup import mix

#: Bits in which fingerprints of candidates differ at most.
RADIUS = 2
#: Bands of a signature, and minima in each.
BANDS, ROWS = 24, 5
#: What the share of equal minima may be under the similarity; over five standard deviations.
SLACK = 0.2
#: Texts of a block, where candidates are too many for one task.
TILE = 512
#: Bytes of text for each bucket and for each partition of buckets, and the least number of buckets.
BUCKET, PARTITION, LEAST_BUCKETS = 2 << 20, 8 << 20, 64

FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the word shingles, in order."""
    return np.unique(simhash.hashes(text, width))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        np.minimum(out, (FACTORS[:, None] * s[None, k : k + 2048]).min(axis=1), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def tile_links(sets: list[np.ndarray], blocks: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A spanning set of the links among texts of one block, or between those of two."""
    low, size = np.array([minima(s) for s in sets]), np.array([len(s) for s in sets])
    apart = blocks.min() != blocks.max()
    root = np.arange(len(sets))
    out = []
    for i in range(len(sets) - 1):
        rest = slice(i + 1, None)
        maybe = ((low[rest] == low[i]).mean(axis=1) >= least - SLACK) & (np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i]) - 1e-6)
        if apart:
            maybe &= blocks[rest] != blocks[i]
        for j in (np.flatnonzero(maybe) + i + 1).tolist():
            if root[i] != root[j] and similarity(sets[i], sets[j]) >= least:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def links(texts: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(a, b): a spanning set of the links between distinct texts (columns node and text, read more than once)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, keys = np.zeros(b.num_rows, np.uint64), []
            for k, t in enumerate(b.column(1)):
                h = simhash.hashes(t.as_py(), width)
                fps[k] = simhash.majority(h)
                keys.append(band_keys(minima(np.unique(h))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["node", "fp", "keys"])

    signed = stored(texts.select("node", "text").mapInArrow(sign, "node long, fp long, keys array<long>"), "signatures")
    first = cut(signed.groupBy("fp").agg(F.min("node").alias("low")))
    alike = signed.select("node", "fp").join(first, "fp").filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    ends = [first.select(F.col("fp").alias(k), F.col("low").alias(f"{k}_node")) for k in ("a", "b")]
    near = simhash.links(first, RADIUS).join(ends[0], "a").join(ends[1], "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    banded = signed.select("node", F.explode("keys").alias("key"))
    groups = banded.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key", "low")
    stars = banded.join(groups, "key").filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    near = cut(components(stars.unionByName(alike).unionByName(near)))
    sizes = near.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = near.join(sizes, "label").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("node", "block", F.xxhash64("label", F.least("block", "other"), F.greatest("block", "other")).alias("tile"))
    placed = cut(placed.join(texts.select("node", F.octet_length("text").alias("size")), "node"))
    total = int(placed.agg(F.sum("size")).first()[0] or 0)
    n, p = max(LEAST_BUCKETS, total // BUCKET), max(8, total // PARTITION)

    def compare(t: pa.Table) -> pa.Table:
        node, block, tile = (t.column(c).to_numpy() for c in ("node", "block", "tile"))
        order = np.lexsort((node, tile))
        found: list[tuple[int, int]] = []
        for part in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
            sets = [shingles(x, width) for x in t.column("text").take(pa.array(part)).to_pylist()]
            found += [(int(node[part[i]]), int(node[part[j]])) for i, j in tile_links(sets, block[part], least)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    full = placed.drop("size").join(texts.select("node", "text"), "node").withColumn("bucket", F.pmod("tile", F.lit(n)))
    return full.repartition(p, "bucket").groupBy("bucket").applyInArrow(compare, "a long, b long")


def keep_first(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id, then text hash, with all its columns."""
    key, doc = F.md5(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("long")
    each = docs.select(key.alias("key"), doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    texts = each.groupBy("key").agg(F.min("doc").alias("first"), F.any_value("text").alias("text"))
    texts = stored(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    names = texts.select("node", "key", "first")
    linked = cut(components(links(texts, width, least)).join(names, "node"))
    stays = linked.groupBy("label").agg(F.min(F.struct(F.col("first").isNull(), "first", "key", "node"))["node"].alias("node"))
    goes = linked.join(stays, "node", "left_anti").select("node")
    row = lambda k, d: F.concat_ws("/", k, d.cast("string"))
    left = names.join(goes, "node", "left_anti").select(row(F.col("key"), F.col("first")).alias("__tv_row"))
    return docs.withColumn("__tv_row", row(key, doc)).join(left, "__tv_row", "left_semi").dropDuplicates(["__tv_row"]).select(docs.columns)
