"""N-gram Jaccard join: exact links of texts by their word shingles, by partitions of the universe and the pigeonhole.

Sets x and y with a Jaccard similarity of percent / 100 at least differ in so many elements at most: H = (x + y) *
(100 - percent) / (100 + percent). Hashes divide the universe of shingles into segments, for each band of set sizes into as many as its
largest sets need. The larger set of a pair (both, if equal) is the one that asks. It gives each of its segments 0, 1 or 2, H + 1 in sum,
so one segment must differ in fewer elements than it was given: equal (1), or one element more or less on one
side (2). So sets leave the hashes of all segments, and of their large segments with one element left out; those of
1 are asked for as they are, those of 2 also with one element left out. Common segments, as empty ones or a licence line's, cost most
and get 0 first, in exchange for large ones that get 2; what is common is counted over all texts.

1. Equal sets are one node. Occurrences of segments are counted, and those of common ones listed (2**20 at most).
2. Hashes are dealt out, packed, in buckets; those of common segments by node, so that they aren't gathered: their groups are
   aggregated and split by Spark. What stays are groups of nodes that share a hash, one of them asking.
3. A group's centre is its node with the most groups (the text of which others are copies has all its segments in common).
   Each node is compared with the centre with which it shares most hashes. Similar ones make first components, by centres of centres.
4. Groups that still hold several components are gone through in tiles, those that mostly belong to one component
   together, so that a node isn't sent once per hash, and that component's nodes only to blocks of the others. Pairs across components are told off by bitmaps of their hashes: each bit in which
   they differ is an element in which the sets differ. First each node is compared with its nearest, which joins
   nearly all that belongs together, then what is left is gone through once more, with all pairs that the bitmaps allow. No pair within a
   component needs to be.
5. Links are closed into components.

Equality is that of 64-bit hashes of words and shingles (and nodes are told apart by such: n sets collide with a probability of n^2 / 2^65).

Edge cases: a text without words, null or empty, has no shingles and no links; of fewer words than a shingle they all are one;
rows without doc_id link others but name no component unless it has no other; rows that repeat a doc_id are told apart by
their texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored
from .simhash import components
from .suffix_dedup import by_bucket, mix, pack, powers, unpack

#: Bytes of words that are hashed at once.
PIECE = 1 << 16
#: Ratio of the largest to the smallest set of a band.
RATIO = 1.5
#: Elements from which a segment is large, by the number of segments: few segments need more freedom of choice.
LARGE = ((24, 3), (64, 7), (1 << 62, 9))
#: Hashes that a map task counts, or packs, at once; bytes of packed ones that it sends at once.
HELD, SENT = 1 << 20, 1 << 21
#: Times that a hash occurs in HELD ones before it counts as common there, and in all, as a number and as a share of all hashes.
LOCAL, COMMON, SHARE = 6, 1000, 1 << 20
#: A segment that is shared by more is worth giving a 2 to another one.
DEAR = 32
#: Hashes of a bucket, buckets of a partition, and the least number of buckets.
BUCKET, TOGETHER, LEAST_BUCKETS = 160_000, 4, 32
#: Nodes that are compared with one copy of a centre, nodes of a tile's side, and shingles of a bucket of texts.
BLOCK, TILE, SHINGLES = 256, 2048, 250_000

ROW = np.dtype([("k", "<u4"), ("f", "u1"), ("node", "<i8")])
OFTEN = np.dtype([("key", "<i8"), ("node", "<i8"), ("asks", "u1")])
GOLD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word, A-Z lower-cased."""
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    found, at = [], 0
    while at < len(joined):
        end = joined.find(b" ", at + PIECE)
        end = len(joined) if end < 0 else end
        buf = np.frombuffer(joined[at:end], np.uint8)
        up, down = powers(max(PIECE, len(buf)) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
        gaps = np.flatnonzero(buf == 32)
        start, stop = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(buf)]])
        found.append(mix((sums[stop] - sums[start]) * down[start]))
        at = end + 1
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct hashes of the word shingles, in order."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * GOLD + w[i : len(w) - k + 1 + i]  # word hashes are mixed
    return distinct(mix(h))


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def node_of(s: np.ndarray) -> int:
    total = (int(s.sum(dtype=np.uint64)) + len(s) * int(GOLD)) & ((1 << 64) - 1)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def most_apart(size: int, percent: int) -> int:
    """Elements in which a set of this size and a similar one that isn't larger differ at most."""
    return 2 * size * (100 - percent) // (100 + percent)


@cache
def band_of(size: int) -> tuple[int, int, int]:
    """(number, smallest, largest size) of a size's band."""
    number, low = 0, 1
    while True:
        high = max(low, int(low * RATIO))
        if size <= high:
            return number, low, high
        number, low = number + 1, high + 1


@cache
def segments(number: int, high: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first hash of each segment, what tells its hashes from others', elements from which it is large) of a band."""
    count = most_apart(high, percent) + 1
    count += count // 16
    first = np.array([(i << 64) // count for i in range(count)], np.uint64)
    return first, mix(np.arange(count, dtype=np.uint64) + np.uint64(number << 32) + GOLD), next(x for m, x in LARGE if count <= m)


def signatures(s: np.ndarray, g: np.ndarray, sums: np.ndarray, high: int, number: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, elements) of each segment in a band, (hash, segment) of each large one with an element left out.

    g and sums: second hashes of the elements s, and their sums up to each.
    """
    first, salt, large = segments(number, high, percent)
    edge = np.append(np.searchsorted(s, first), len(s))
    start, size = edge[:-1], edge[1:] - edge[:-1]
    whole = sums[edge[1:]] - sums[start]
    big = np.flatnonzero(size >= large)
    of = np.repeat(big, size[big])
    out = np.arange(len(of)) - np.repeat(np.cumsum(size[big]) - size[big], size[big]) + start[of]
    return mix(whole ^ salt), size, mix((whole[of] - g[out]) ^ salt[of]), of


def allotted(size: np.ndarray, cost: np.ndarray, need: int, large: int) -> np.ndarray:
    """0, 1 or 2 for each segment, need in sum at least, at the least cost: the dearest ones get nothing first."""
    give = np.ones(len(size), np.int64)
    order = np.lexsort((size, -cost))  # dearest first, of equals the smallest
    spare = len(size) - need
    give[order[:spare]] = 0
    dear = order[spare:]
    dear = dear[cost[dear] > DEAR]
    if not len(dear):
        return give
    able = [i for i in order[::-1] if size[i] >= large and give[i] and cost[i] <= DEAR]
    able.sort(key=lambda i: size[i])
    for i, j in zip(dear, able):
        give[i], give[j] = 0, 2
    return give


def rows_of(s: np.ndarray, percent: int, common: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether the set asks for it) of a set in its own band and in that of the largest similar sets."""
    own = band_of(len(s))
    bands, size = [own], len(s) * 100 // percent
    while bands[-1][2] < size:
        bands.append(band_of(bands[-1][2] + 1))
    keys, asks = [], []
    g = mix(s + GOLD)
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(g, out=sums[1:])
    for number, _, high in bands:
        whole, held, less, of = signatures(s, g, sums, high, number, percent)
        ask, ask_less = np.zeros(len(whole), bool), np.zeros(len(less), bool)
        if (number, high) == (own[0], own[2]) and most_apart(len(s), percent):
            at = np.minimum(np.searchsorted(common, whole), max(0, len(common) - 1))
            cost = np.where(common[at] == whole, times[at], 1) if len(common) else np.ones(len(whole), np.int64)
            give = allotted(held, cost, most_apart(len(s), percent) + 1, segments(number, high, percent)[2])
            ask, ask_less = give > 0, give[of] == 2
        keys += [whole, less]
        asks += [ask, ask_less]
    return np.concatenate(keys), np.concatenate(asks)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def bitmap(s: np.ndarray) -> bytes:
    """Which last bits of hashes occur; four to eight bits an element, 2**17 at most."""
    bits = 1 << min(17, max(6, (4 * len(s) - 1).bit_length()))
    there = np.zeros(bits, bool)
    there[(s & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(there, bitorder="little").tobytes()


def folded(held: list[bytes]) -> np.ndarray:
    """Bitmaps of different sizes as rows of the smallest one's."""
    size = min(map(len, held))
    low = np.array([np.bitwise_or.reduce(np.frombuffer(h, np.uint8).reshape(-1, size), axis=0) for h in held])
    return np.ascontiguousarray(low).view(np.uint64)


def tile_pairs(label: np.ndarray, asks: np.ndarray, block: np.ndarray, size: np.ndarray, held: list[bytes], percent: int, nearest: bool) -> set[tuple[int, int]]:
    """Places of two nodes across components, one asking, whose bitmaps allow the similarity; nearest: of each node the closest one."""
    apart = block.min() != block.max()
    band = np.array([band_of(int(x))[0] for x in size])
    best, whom = np.full(len(size), np.iinfo(np.int64).max), np.full(len(size), -1)
    found = set()
    for b in np.unique(band):
        part = np.flatnonzero((band >= b) & (band <= b + 1))  # sizes of one or of neighbouring bands
        low = folded([held[k] for k in part.tolist()])
        for x in np.flatnonzero(band[part] == b):
            i = part[x]
            y = np.flatnonzero((band[part] > b) | (part > i))
            j = part[y]
            fits = (label[j] != label[i]) & (asks[j] | asks[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))
            if apart:
                fits &= block[j] != block[i]
            y, j = y[fits], j[fits]
            if not len(j):
                continue
            differ = np.bitwise_count(low[y] ^ low[x]).sum(axis=1, dtype=np.int64)
            fits = (100 + percent) * differ <= (100 - percent) * (size[j] + size[i])
            j, differ = j[fits], differ[fits]
            if not len(j):
                continue
            if not nearest:
                found.update((int(i), k) for k in j.tolist())
                continue
            closer = differ < best[j]
            best[j[closer]], whom[j[closer]] = differ[closer], i
            k = int(differ.argmin())
            if differ[k] < best[i]:
                best[i], whom[i] = differ[k], j[k]
    return found | {(k, int(whom[k])) for k in np.flatnonzero(whom >= 0).tolist()}


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; the list is emptied, so that they aren't held beside it."""
    whole = np.concatenate(parts)
    parts.clear()
    return whole


def counted(held: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, times) of those that occur so often; held is emptied."""
    x = joined(held)
    x.sort()
    last = x[least - 1 :]
    u = np.unique(last[last == x[: len(last)]])
    return u, np.searchsorted(x, u, "right") - np.searchsorted(x, u)


def packed(rare: list[np.ndarray], places: list[np.ndarray], often: list[np.ndarray], count: int) -> Iterator[pa.RecordBatch]:
    """bucket, rare, often: rows by their buckets (places; count of them), SENT bytes or little more at once; the lists are emptied."""

    def cells() -> Iterator[tuple[int, bytes | None, bytes | None]]:
        row = joined(rare)
        for k, part in by_bucket(row, joined(places)):
            yield k, pack(row[part]), None
        row = joined(often)
        for k, part in by_bucket(row, np.mod(row["node"], count)):
            yield k, None, pack(row[part])

    held, size = [], 0
    for cell in cells():
        held.append(cell)
        size += len(cell[1] or cell[2])
        if size > SENT:
            yield cells_of(held)
            held, size = [], 0
    if held:
        yield cells_of(held)


def cells_of(held: list[tuple[int, bytes | None, bytes | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in held], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "rare", "often"])


def sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc, tag, n, node and rows (its hashes) of every document, and key, times of what tasks find common, in rows of their own."""

    local, most = LOCAL, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, zero = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def common() -> pa.RecordBatch:
            u, n = counted(held or [none], local)
            gone = pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([gone] * 5 + [pa.array(u.view(np.int64)), pa.array(n)], names)

        names = ["doc", "tag", "n", "node", "rows", "key", "times"]
        for b in batches:
            found = []
            for t in b.column(2):
                s = shingles(t.as_py(), width)
                node = node_of(s)
                if not len(s) or node in seen:
                    found.append((len(s), node, 0))
                    continue
                seen.add(node)
                keys = rows_of(s, percent, none, zero)[0]
                found.append((len(s), node, len(keys)))
                held.append(keys)
                size += len(keys)
                if size > most:
                    yield common()
                    size = 0
            gone = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x[i] for x in found], pa.int64()) for i in range(3)), gone, gone], names)
        yield common()

    kind = ", ".join(f"{c} long" for c in ("doc", "tag", "n", "node", "rows", "key", "times"))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(run, kind)


def shared(docs: DataFrame, own: DataFrame, width: int, percent: int) -> DataFrame:
    """key, node, asks: nodes that share a hash with others, one of them asking."""
    total = int(own.agg(F.sum("rows")).first()[0] or 0)
    most = own.filter("key is not null").groupBy("key").agg(F.sum("times").alias("times")).filter(F.col("times") >= max(COMMON, total // SHARE))
    listed = most.toArrow()  # SHARE rows at most
    order = np.argsort(listed.column("key").to_numpy().view(np.uint64))
    common, times = listed.column("key").to_numpy().view(np.uint64)[order], listed.column("times").to_numpy()[order]
    sent = docs.sparkSession.sparkContext.broadcast((common, times))
    count, pieces = max(LEAST_BUCKETS, total // BUCKET), HELD

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """node, hashes, asks, and which hashes are common, of a task's distinct sets."""
        seen: set[int] = set()
        known, known_times = sent.value
        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), width)
                node = node_of(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    keys, asks = rows_of(s, percent, known, known_times)
                    listed = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)
                    yield node, keys, asks, listed

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare: list[np.ndarray] = []
        places: list[np.ndarray] = []
        often: list[np.ndarray] = []
        size = 0
        for node, keys, asks, listed in each(batches):
            key = keys[~listed]
            row = np.zeros(len(key), ROW)
            row["k"], row["node"] = key & np.uint64(0xFFFFFFFF), node
            row["f"] = ((key >> np.uint64(32)) & np.uint64(0x7F)) * np.uint64(2) + asks[~listed]
            more = np.zeros(len(keys) - len(key), OFTEN)
            more["key"], more["node"], more["asks"] = (keys[listed] | np.uint64(1 << 63)).view(np.int64), node, asks[listed]
            rare.append(row)
            places.append(((key >> np.uint64(40)).astype(np.int64) % count).astype(np.int32))
            often.append(more)
            size += len(keys)
            if size > pieces:
                yield from packed(rare, places, often, count)
                size = 0
        if rare:
            yield from packed(rare, places, often, count)

    def group(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        r = np.concatenate([np.zeros(0, ROW), *(unpack(x, ROW) for x in t.column("rare").to_pylist() if x)])
        key = (r["f"] >> 1).astype(np.int64) << 32 | r["k"]
        order = np.lexsort((r["node"], key))
        key, node, asks = key[order], r["node"][order], (r["f"][order] & 1).astype(bool)
        if len(key):
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            at = np.flatnonzero(new)
            key, node, asks = key[at], node[at], np.logical_or.reduceat(asks, at)
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            at, of = np.flatnonzero(first), np.cumsum(first) - 1
            keep = ((np.diff(at, append=len(key)) > 1) & np.logical_or.reduceat(asks, at))[of]
            key, node, asks = key[keep] | np.int64(bucket) << 39, node[keep], asks[keep]
        o = np.concatenate([np.zeros(0, OFTEN), *(unpack(x, OFTEN) for x in t.column("often").to_pylist() if x)])
        o = np.unique(o)  # exact copies, told of by several tasks
        common = np.arange(len(key) + len(o)) >= len(key)
        return pa.table({"key": np.concatenate([key, o["key"]]), "node": np.concatenate([node, o["node"]]), "asks": np.concatenate([asks, o["asks"].astype(bool)]), "common": common})

    dealt = docs.select("text").mapInArrow(deal, "bucket int, rare binary, often binary").repartition(max(8, count // TOGETHER), "bucket")
    met = stored(dealt.groupBy("bucket").applyInArrow(group, "key long, node long, asks boolean, common boolean"), "met")
    many = met.filter("common").drop("common")
    live = many.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("asks").alias("any")).filter("low < high and any").select("key")
    return met.filter("not common").drop("common").unionByName(many.join(F.broadcast(live), "key"))  # SHARE keys at most


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the nodes (node, doc, tag)."""
    by = F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("__tag") == F.col("tag"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("__tag")).join(nodes, by)
    return rows.groupBy("node").agg(F.any_value("text").alias("text"))  # rows that repeat an id and a text


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b; distinct, read more than once) that are similar; nodes: node, doc, tag, n."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).filter("blocks > 1")
    dealt = pairs.join(many, "a", "left").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.coalesce("blocks", F.lit(1)))).alias("tile"))
    placed = dealt.select("tile", "a", F.col("b").alias("node")).union(dealt.select("tile", "a", F.col("a").alias("node")).distinct())
    placed = cut(placed.join(nodes, "node"))
    count = max(LEAST_BUCKETS, int(placed.agg(F.sum("n")).first()[0] or 0) // SHINGLES)

    def compare(t: pa.Table) -> pa.Table:
        a, node = t.column("a").to_pylist(), t.column("node").to_pylist()
        held = {}
        for k, x in enumerate(node):
            if x not in held:
                held[x] = shingles(t.column("text")[k].as_py(), width)
        found = sorted({(x, y) for x, y in zip(a, node) if x != y and similar(held[x], held[y], percent)})
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    texts = texts_of(docs, placed.select("node", "doc", "tag").distinct())
    full = placed.select("tile", "a", "node").join(texts, "node").withColumn("bucket", F.pmod("tile", F.lit(count)))
    return full.repartition(max(8, count // TOGETHER), "bucket").groupBy("bucket").applyInArrow(compare, "a long, b long")


def centres(groups: DataFrame) -> DataFrame:
    """a, b: each node b with the centre of its groups with which it shares most hashes."""
    weight = groups.groupBy("node").agg(F.count(F.lit(1)).alias("weight"))
    centre = groups.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"))
    meets = groups.join(centre, "key").filter("node <> centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("times"))
    best = meets.groupBy("node").agg(F.max(F.struct("times", "centre"))["centre"].alias("a"))
    return best.select("a", F.col("node").alias("b"))


def roots(known: DataFrame, rounds: int = 2) -> DataFrame:
    """node, label of links (a, b) of which each b has one a, its centre: a centre's centre, and so on; a round doubles the steps."""
    label = known.select(F.col("b").alias("node"), F.col("a").alias("label"))
    for _ in range(rounds):
        up = label.select(F.col("node").alias("via"), F.col("label").alias("far"))
        label = cut(label.join(up, F.col("label") == F.col("via"), "left").select("node", F.coalesce("far", "label").alias("label")))
    return label


def across(groups: DataFrame, label: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int, nearest: bool) -> DataFrame:
    """a, b: pairs of a group across components that may be similar; nearest: for each node only the closest one."""
    told = groups.join(label, "node", "left").select("key", "node", "asks", F.coalesce("label", "node").alias("label"))
    parts = told.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("any"))
    live = parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"), F.max("any").alias("any")).filter("labels > 1 and any")
    mostly = F.when(2 * F.col("top.n") >= F.col("n"), F.xxhash64("top.label", F.lit(1))).otherwise(F.xxhash64("key", F.lit(2)))
    units = live.select("key", mostly.alias("unit"), F.col("top.label").alias("most"))
    left = cut(told.join(units, "key").groupBy("unit", "node", "label").agg(F.max("asks").alias("asks"), (F.max("most") == F.col("label")).alias("major")))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bitmap(shingles(t.as_py(), width)) for t in b.column(1)], pa.binary())], ["node", "held"])

    there = cut(left.select("node").distinct().join(nodes, "node"))
    held = stored(texts_of(docs, there.select("node", "doc", "tag")).mapInArrow(sketch, "node long, held binary").join(there.select("node", "n"), "node"), "bitmaps")
    # Nodes of a unit's largest component needn't meet each other: they go to the blocks of the others only.
    most = lambda fits: F.ceil(F.count_if(fits) / TILE)
    sizes = left.groupBy("unit").agg(most(~F.col("major")).alias("few"), most(F.col("major")).alias("many"))
    dealt = left.join(sizes, "unit").withColumn("b", F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("major"), F.col("many")).otherwise(F.col("few")), F.lit(1))))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    tile = lambda block, kind, x, y: F.struct(block.cast("long").alias("block"), F.xxhash64("unit", F.lit(kind), x, y).alias("tile"))
    b = F.col("b")
    mixed = F.transform(upto("many"), lambda k: tile(b, 1, b, k))
    own = F.concat(F.transform(upto("few"), lambda k: tile(b, 0, F.least(b, k), F.greatest(b, k))), mixed)
    placed = dealt.select("node", "label", "asks", F.explode(F.when(F.col("major"), F.transform(upto("few"), lambda k: tile(F.lit(-1), 1, k, b))).otherwise(own)).alias("t"))
    placed = placed.select("node", "label", "asks", "t.*")
    count = max(LEAST_BUCKETS, placed.count() // TILE)

    def pairs(t: pa.Table) -> pa.Table:
        node, label, asks, block, tile, size = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "asks", "block", "tile", "n"))
        found = set()
        for _, part in by_bucket(tile, tile):
            bodies = t.column("held").take(pa.array(part)).to_pylist()
            for i, j in tile_pairs(label[part], asks[part].astype(bool), block[part], size[part], bodies, percent, nearest):
                x, y = int(node[part[i]]), int(node[part[j]])
                found.add((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    full = placed.join(held, "node").withColumn("bucket", F.pmod("tile", F.lit(count)))
    return full.repartition(max(8, count // TOGETHER), "bucket").groupBy("bucket").applyInArrow(pairs, "a long, b long").distinct()


def links(docs: DataFrame, own: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(node, label): components of distinct sets (own: see sets) that are linked with others."""
    least = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "tag")).alias("least")
    nodes = own.filter("n > 0").groupBy("node").agg(least, F.max("n").alias("n")).select("node", "least.doc", "least.tag", "n")
    nodes = stored(nodes, "nodes")
    groups = stored(shared(docs, own, width, percent), "groups")
    known = cut(verified(cut(centres(groups)), docs, nodes, width, percent))
    for nearest in (True, False):
        label = roots(known) if nearest else components(known, rounds=2, settle=False)
        known = known.union(cut(verified(cut(across(groups, label, docs, nodes, width, percent, nearest)), docs, nodes, width, percent)))
    return components(known)


def classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) of every document (doc_id, text)."""
    own = stored(sets(docs, width, percent), "sets")
    label = cut(links(docs, own, width, percent))
    each = own.filter("node is not null").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "node")
    least = each.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = least.groupBy("label").agg(F.min("least").alias("component"))
    # Cut off, so that the last join has exchanges of its own and a set of very many documents is split.
    of = cut(least.join(lowest, "label").select("node", "component"))
    return each.join(of, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
