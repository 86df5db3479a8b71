"""Exact removal of repeated byte strings, by a depth-limited radix sort of suffixes.

Every byte string of the threshold length (a window: the first bytes of a suffix) that also starts earlier
is covered and removed. Suffixes are ordered by most-significant-digit passes, and only those that still
share all digits with another go on to the next pass; what is left after the last digit are exactly the
repeated windows.

1. The first digit of a suffix is the least hash among the SEED-byte strings of its window. Neighbouring
   suffixes share it, so one record stands for a run of them (35 on average), with a digest of all bytes
   that the run's windows cover. Records are dealt out by digit. A run whose digit occurs nowhere else is
   done; a run with the digest of an earlier one repeats it as a whole; only the first of each digest (and
   what rows of the same doc_id have in its place) goes on, and only if its digit has several digests. Strings that are very common (as in a licence line) are counted
   beforehand over all texts and come last in the order of hashes: a window takes one as its digit only if it
   holds no other string, so that a common line in very many surroundings isn't one group.
2. The bytes of those runs are fetched and dealt out by digit again, and the suffixes are sorted by
   8-byte digits of the window, pass by pass, until the threshold.
3. Repeats are put together per document.

Records travel packed, many to a row; tasks hold one bucket at a time. The numbers of buckets and of partitions follow
the size of the input.

Edge cases: a null text counts as empty; texts shorter than the threshold lose nothing; a null doc_id comes
before all others; rows that repeat both doc_id and text are one document and give repeated results; rows
with the same doc_id and other texts are told apart by 64-bit hashes of their texts, and of two equal windows at the same
place in both none is the earlier; an empty table gives an empty result; further columns are kept by strip()
and ignored by digest().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored

#: Bytes of the strings among which a window's first digit is chosen.
SEED = 32
#: Bytes of text that a map task works on at once.
PIECE = 1 << 20
#: Bytes of text for each bucket, and the least number of buckets.
BUCKET, LEAST_BUCKETS = 2 << 20, 64
#: Bytes of text for each partition of buckets: their number follows the input, whatever the session's setting.
PARTITION = 8 << 20
#: Times that a string occurs in a piece before it counts as common there, and in all, as a number and as a share of all
#: bytes; by the share there are 2**22 common strings at most.
LOCAL, COMMON, SHARE = 3, 20_000, 1 << 22
#: Of the strings that are rarer in a piece, those with hashes in the lowest quarter (a window's digit nearly always is
#: there) are counted by one occurrence in so many, so that a line that stands once in every piece is noticed.
NOTED = 256
#: Set in the hashes of common strings, so that they come last.
LAST = np.uint64(1 << 63)
#: Added to the number of a run that may repeat itself; greater than any number.
TIED = 128
#: Stands for a null doc_id.
NONE = -(1 << 63)

RUN = np.dtype([("v", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("tag", "<u8"), ("n", "u1")])
WANTED = np.dtype([("v", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("tag", "<u8"), ("n", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("at", "<u4"), ("size", "<u4"), ("tag", "<u8")])

BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def pack(x: np.ndarray) -> bytes:
    """Records as byte planes, which compress better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def unpack(b: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def by_bucket(x: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of all buckets that occur."""
    if len(bucket) and bucket.min() >= 0 and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by radix
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), part


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]))
        _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(BASE, -1, 1 << 64), np.uint64)]))
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Least (or greatest) value in each window."""
    n = 1
    while 2 * n <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def string_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash sums up to each byte, hash of the string that begins at each byte), the latter below LAST."""
    n = len(buf)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return sums, mix((sums[SEED:] - sums[:-SEED]) * down[: n - SEED + 1]) >> np.uint64(1)


def frequent(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, times) of the strings that occur LOCAL times at least in buf."""
    if len(buf) < SEED:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = string_hashes(buf)[1].astype(np.int64)
    cell = x & ((1 << 22) - 1)
    u, n = np.unique(x[np.bincount(cell, minlength=1 << 22)[cell] >= LOCAL], return_counts=True)
    return u[n >= LOCAL], n[n >= LOCAL]


def noted(buf: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, estimated times) of a random share of the occurrences in buf of strings that aren't known."""
    if len(buf) < SEED:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = string_hashes(buf)[1]
    low = x[x < LAST >> np.uint64(2)]
    chance = mix(low ^ mix(x[:1] + np.uint64(len(buf)))) % np.uint64(NOTED)
    u, n = np.unique(low[chance == 0].astype(np.int64), return_counts=True)
    new = ~np.isin(u, known)
    return u[new], n[new] * NOTED


def common_strings(docs: DataFrame, total: int) -> np.ndarray:
    """Hashes, in order, of the strings that count as common among all texts; which these are never changes the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b"".join(bytes_of(b.column(0)))
            for k in range(0, len(whole), PIECE):
                buf = np.frombuffer(whole[k : k + PIECE], np.uint8)
                u, n = frequent(buf)
                v, m = noted(buf, u)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, v])), pa.array(np.concatenate([n, m]).astype(np.int64))], ["h", "n"])

    counted = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return np.sort(counted.filter(F.col("n") >= max(COMMON, total // SHARE)).select("h").toArrow().column("h").to_numpy().astype(np.uint64))


def last_if_common(x: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Hashes with LAST set in the common ones."""
    if len(common):
        maybe = np.zeros(1 << 22, bool)
        maybe[common & np.uint64((1 << 22) - 1)] = True
        at = np.flatnonzero(maybe[x & np.uint64((1 << 22) - 1)])
        k = np.minimum(np.searchsorted(common, x[at]), len(common) - 1)
        x[at[common[k] == x[at]]] |= LAST
    return x


def runs(buf: np.ndarray, ends: np.ndarray, threshold: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digit, digest, first suffix, number) of the runs of suffixes in buf; no window crosses one of ends.

    The number has TIED added where the digit's string occurs again nearby, so that the run may repeat itself.
    """
    n, width = len(buf), threshold - SEED + 1
    if n < threshold:
        return tuple(np.zeros(0, np.uint64) for _ in range(4))
    down = powers(n + 1)[1]
    sums, seeds = string_hashes(buf)
    seeds = last_if_common(seeds, common)
    least = slide(seeds, width, np.minimum)
    whole = np.ones(len(least), bool)
    for e in ends:
        whole[max(0, e - threshold + 1) : e] = False
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
    last = whole.copy()
    last[:-1] &= ~whole[1:] | first[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    pieces = (b - a) // width + 1  # ties, as in repetitive text, make runs longer than a window allows
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a, b = np.repeat(a, pieces) + k * width, np.repeat(b, pieces)
    size = np.minimum(b - a + 1, width)
    digest = mix((sums[a + size + threshold - 1] - sums[a]) * down[a] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(seeds == slide(np.concatenate([edge, np.where(whole, least, 0), edge]), width, np.maximum))
    chosen = chosen[np.argsort(seeds[chosen], kind="stable")]
    near = (np.diff(seeds[chosen]) == 0) & (np.diff(chosen) < 2 * width)
    ties = np.unique(seeds[chosen[1:][near]])
    tied = np.isin(least[a], ties) if len(ties) else np.zeros(len(a), bool)
    return least[a], digest, a, size + TIED * tied


def tag_of(b: bytes) -> int:
    """Tells texts of one doc_id apart; Spark's xxhash64 of the text."""
    return xxhash.xxh64_intdigest(b, 42)


def home(x: np.ndarray, d: int) -> np.ndarray:
    """The bucket of each record's text: by doc_id and tag, so that neither rows without id nor copies meet in one."""
    return np.mod(x["doc"] ^ x["tag"].astype(np.int64), d)


def text_runs(ids: list[int], texts: list[bytes], threshold: int, common: np.ndarray = np.zeros(0, np.uint64)) -> Iterator[np.ndarray]:
    """RUN records of the texts, in pieces of about PIECE bytes; long texts overlap from piece to piece."""
    held: list[tuple[int, int, int, bytes]] = []  # doc, tag, start, bytes
    size = 0

    def out() -> np.ndarray:
        ends = np.cumsum([len(x[3]) for x in held])
        v, c, a, n = runs(np.frombuffer(b"".join(x[3] for x in held), np.uint8), ends, threshold, common)
        of = np.searchsorted(ends, a, side="right")
        r = np.zeros(len(a), RUN)
        r["v"], r["c"], r["n"] = v, c, n
        r["doc"] = np.array([x[0] for x in held], np.int64)[of]
        r["tag"] = np.array([x[1] for x in held], np.uint64)[of]
        begin = np.concatenate([[0], ends[:-1]])
        r["at"] = (a - begin[of] + np.array([x[2] for x in held], np.int64)[of]).astype(np.uint32)
        order = np.lexsort((r["at"], r["doc"], r["c"], r["v"]))
        return r[order]

    for doc, b in zip(ids, texts):
        if len(b) < threshold:
            continue
        for k in range(0, len(b) - threshold + 1, PIECE):
            part = b[k : k + PIECE + threshold - 1]
            if held and size + len(part) > PIECE:
                yield out()
                held, size = [], 0
            held.append((doc, tag_of(b), k, part))
            size += len(part)
    if held:
        yield out()


def refined(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all records with some first digits: SPANs that repeat an earlier run, WANTED runs to look into."""
    order = np.lexsort((r["tag"], r["at"], r["doc"], r["c"], r["v"]))
    r = r[order]
    same = np.zeros(len(r), bool)
    same[1:] = r[1:] == r[:-1]
    r = r[~same]
    tied = r["n"] >= TIED
    r["n"] -= TIED * tied.astype(np.uint8)
    new_v, new_c = np.ones(len(r), bool), np.ones(len(r), bool)
    new_v[1:] = r["v"][1:] != r["v"][:-1]
    new_c[1:] = new_v[1:] | (r["c"][1:] != r["c"][:-1])
    kinds = np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_v)) if len(r) else np.zeros(0, np.int64)
    several = kinds[np.cumsum(new_v) - 1] > 1 if len(r) else new_c
    head = np.flatnonzero(new_c)[np.cumsum(new_c) - 1] if len(r) else new_c
    # Rows that share a doc_id have the same place in common: none repeats the other there, so all of them go on.
    other = (r["doc"] != r["doc"][head]) | (r["at"] != r["at"][head]) if len(r) else new_c
    again, wanted = r[other], r[~other & (several | tied)]
    span = np.zeros(len(again), SPAN)
    for k in ("doc", "at", "tag"):
        span[k] = again[k]
    span["size"] = again["n"]
    look = np.zeros(len(wanted), WANTED)
    for k in WANTED.names:
        look[k] = wanted[k]
    return span, look


def repeated(w: np.ndarray, buf: np.ndarray, threshold: int) -> np.ndarray:
    """SPANs (size in suffixes) of the suffixes of runs w that repeat an earlier one; buf: the runs' bytes, joined.

    The radix sort proper: a pass orders the suffixes of each group by their next digit and drops those
    that are alone.
    """
    n = w["n"].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(n + threshold - 1)[:-1]]) if len(w) else n
    run = np.repeat(np.arange(len(w)), n)
    shift = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[run] + shift
    _, group = np.unique(w["v"], return_inverse=True)
    group = group[run].astype(np.uint64)
    eight = np.ndarray((max(0, len(buf) - 7),), "<u8", buf, strides=(1,))
    for depth in [*range(0, threshold - 8, 8), threshold - 8]:
        if not len(at):
            break
        digit = eight[at + depth]
        key = mix(group * np.uint64(BASE) + mix(digit))
        order = np.argsort(key)
        digit, before = digit[order], group[order]
        new = np.ones(len(order), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (before[1:] != before[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        order, group = order[~alone], np.cumsum(new)[~alone].astype(np.uint64)
        at, run, shift = at[order], run[order], shift[order]
    place = w["at"][run].astype(np.int64) + shift
    doc, tag = w["doc"][run], w["tag"][run]
    order = np.lexsort((tag, place, doc, group))
    group, doc, tag, place = group[order], doc[order], tag[order], place[order]
    again = np.zeros(len(order), bool)
    # The same place, told of two rows with one doc_id, doesn't come earlier than itself.
    if len(order):
        start = np.ones(len(order), bool)
        start[1:] = group[1:] != group[:-1]
        head = np.flatnonzero(start)[np.cumsum(start) - 1]
        again = (doc != doc[head]) | (place != place[head])
    doc, tag, place = doc[again], tag[again], place[again]
    order = np.lexsort((place, tag, doc))
    doc, tag, place = doc[order], tag[order], place[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] > place[:-1] + 1)
    k = np.flatnonzero(first)
    out = np.zeros(len(k), SPAN)
    if len(k):
        out["doc"], out["tag"], out["at"] = doc[k], tag[k], place[k]
        out["size"] = place[np.append(k[1:], len(doc)) - 1] - place[k] + 1
    return out


def prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.fill_null(NONE), np.int64)


def bytes_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") if x else b"" for x in column.to_pylist()]


def merged(spans: list[bytes], threshold: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(doc, tag) to its maximal removed (start, end)."""
    s = np.concatenate([np.zeros(0, SPAN), *(unpack(b, SPAN) for b in spans if b)])
    s = s[np.lexsort((s["at"], s["tag"], s["doc"]))]
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    begin, end = s["at"].astype(np.int64), s["at"].astype(np.int64) + s["size"] + threshold - 1
    key = np.ones(len(s), bool)
    key[1:] = (s["doc"][1:] != s["doc"][:-1]) | (s["tag"][1:] != s["tag"][:-1])
    for a, b in zip(k := np.flatnonzero(key), [*k[1:], len(s)]):
        far = np.maximum.accumulate(end[a:b])
        cut = np.flatnonzero(np.append(True, begin[a + 1 : b] > far[:-1]))
        out[int(s["doc"][a]), int(s["tag"][a])] = list(zip(begin[a:b][cut].tolist(), far[np.append(cut[1:], b - a) - 1].tolist()))
    return out


def _found(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, int]:
    """docs with their bucket, the rows (b, spans) of the buckets, and the number of partitions to deal them out to."""
    if not SEED + 8 <= threshold < SEED + TIED:
        raise ValueError(f"the threshold must be from {SEED + 8} to {SEED + TIED - 1}")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(LEAST_BUCKETS, int(total) // BUCKET)
    d = prime_from(n)  # ids in steps still fall into all buckets
    p = max(8, int(total) // PARTITION)
    common = docs.sparkSession.sparkContext.broadcast(common_strings(docs, int(total)))

    def first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in text_runs(ids_of(x.column(0)).tolist(), bytes_of(x.column(1)), threshold, common.value):
                # Of equal runs in one piece the first stands for all; the others are repeats already.
                again = np.zeros(len(r), bool)
                again[1:] = (r["v"][1:] == r["v"][:-1]) & (r["c"][1:] == r["c"][:-1])
                head = np.flatnonzero(~again)[np.cumsum(~again) - 1] if len(r) else again
                moved = again & ((r["doc"] != r["doc"][head]) | (r["at"] != r["at"][head]))
                left, gone = r[~moved], r[moved]
                rows = [(b, pack(left[k]), None) for b, k in by_bucket(left, left["v"] % np.uint64(n))]
                span = np.zeros(len(gone), SPAN)
                for k in ("doc", "at", "tag"):
                    span[k] = gone[k]
                span["size"] = gone["n"] % TIED
                rows += [(-1 - b, None, pack(span[k])) for b, k in by_bucket(span, home(span, d))]
                yield pa.RecordBatch.from_pylist([dict(zip(("b", "runs", "spans"), row)) for row in rows], pa.schema([("b", pa.int64()), ("runs", pa.binary()), ("spans", pa.binary())]))

    def refine(t: pa.Table) -> pa.Table:
        b = t.column("b")[0].as_py()
        rows = []
        if b < 0:
            rows.append((-1 - b, b"".join(t.column("spans").to_pylist()) if len(t) == 1 else pack(np.concatenate([unpack(x, SPAN) for x in t.column("spans").to_pylist()])), None))
        else:
            span, look = refined(np.concatenate([unpack(x, RUN) for x in t.column("runs").to_pylist()]))
            rows += [(k, pack(span[p]), None) for k, p in by_bucket(span, home(span, d))]
            rows += [(k, None, pack(look[p])) for k, p in by_bucket(look, home(look, d))]
        return pa.Table.from_pylist([dict(zip(("b", "spans", "wanted"), r)) for r in rows], pa.schema([("b", pa.int64()), ("spans", pa.binary()), ("wanted", pa.binary())]))

    def fetch(docs: pa.Table, t: pa.Table) -> pa.Table:
        kind = pa.schema([("h", pa.int64()), ("runs", pa.binary()), ("bytes", pa.binary())])
        w = np.concatenate([np.zeros(0, WANTED), *(unpack(x, WANTED) for x in t.column("wanted").to_pylist() if x)])
        if not len(w) or not len(docs):
            return kind.empty_table()
        w = w[np.lexsort((w["tag"], w["doc"]))]
        texts = {}
        for doc, b in zip(ids_of(docs.column("__tv_id")).tolist(), bytes_of(docs.column("__tv_text"))):
            if len(b) >= threshold:
                texts[doc, tag_of(b)] = b
        edge = np.flatnonzero(np.append(True, (w["doc"][1:] != w["doc"][:-1]) | (w["tag"][1:] != w["tag"][:-1])))
        part, at = [], 0
        start = np.zeros(len(w), np.int64)
        for a, b in zip(edge, [*edge[1:], len(w)]):
            x = texts[int(w["doc"][a]), int(w["tag"][a])]
            start[a:b] = w["at"][a:b].astype(np.int64) + at
            part.append(x)
            at += len(x)
        buf = np.frombuffer(b"".join(part), np.uint8)
        rows = []
        for h, k in by_bucket(w, w["v"] % np.uint64(n)):
            size = w["n"][k].astype(np.int64) + threshold - 1
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            rows.append({"h": h, "runs": pack(w[k]), "bytes": buf[np.repeat(start[k], size) + inner].tobytes()})
        return pa.Table.from_pylist(rows, kind)

    def order(t: pa.Table) -> pa.Table:
        w = [unpack(x, WANTED) for x in t.column("runs").to_pylist()]
        s = repeated(np.concatenate(w), np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8), threshold)
        rows = [{"b": k, "spans": pack(s[p])} for k, p in by_bucket(s, home(s, d))]
        return pa.Table.from_pylist(rows, pa.schema([("b", pa.int64()), ("spans", pa.binary())]))

    own = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first_digits, "b long, runs binary, spans binary")
    known = stored(own.repartition(p, "b").groupBy("b").applyInArrow(refine, "b long, spans binary, wanted binary"), "repeats", compression="zstd")
    placed = docs.withColumn("__tv_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE))).withColumn("__tv_bucket", F.pmod(F.col("__tv_id").bitwiseXOR(F.xxhash64("text")), F.lit(d)))
    slim = placed.select("__tv_bucket", "__tv_id", F.col("text").alias("__tv_text"))
    wanted = known.filter("wanted is not null").select("b", "wanted")
    runs_ = slim.repartition(p, "__tv_bucket").groupBy("__tv_bucket").cogroup(wanted.repartition(p, "b").groupBy("b")).applyInArrow(fetch, "h long, runs binary, bytes binary")
    more = runs_.repartition(p, "h").groupBy("h").applyInArrow(order, "b long, spans binary")
    return placed, known.filter("spans is not null").select("b", "spans").unionByName(more), p


def digest(docs: DataFrame, threshold: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end in bytes) of every document."""
    placed, found, p = _found(docs, threshold)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"

    def finish(docs: pa.Table, t: pa.Table) -> pa.Table:
        spans = merged(t.column("spans").to_pylist(), threshold)
        rows = []
        for doc, i, b in zip(docs.column("doc_id").to_pylist(), ids_of(docs.column("__tv_id")).tolist(), bytes_of(docs.column("__tv_text"))):
            gone = spans.get((i, tag_of(b)), []) if len(b) >= threshold else []
            sha, at = hashlib.sha256(), 0
            for x, y in gone:
                sha.update(b[at:x])
                at = y
            sha.update(b[at:])
            rows.append({"doc_id": doc, "n_bytes": len(b), "n_removed": sum(y - x for x, y in gone), "n_spans": len(gone), "kept_sha256": sha.hexdigest(), "spans": [{"start": x, "end": y} for x, y in gone]})
        kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        return pa.Table.from_pylist(rows, kind)

    slim = placed.select("__tv_bucket", "__tv_id", F.col("text").alias("__tv_text"), F.col("doc_id").cast("long"))
    return slim.repartition(p, "__tv_bucket").groupBy("__tv_bucket").cogroup(found.repartition(p, "b").groupBy("b")).applyInArrow(finish, schema)


def kept_text(b: bytes, gone: list[tuple[int, int]]) -> str:
    """What is left of a text; a character that a span only touches stays."""
    out, at = [], 0
    for x, y in gone:
        while x < y and b[x] & 0xC0 == 0x80:
            x += 1
        while y > x and y < len(b) and b[y] & 0xC0 == 0x80:
            y -= 1
        out.append(b[at:x])
        at = y
    return b"".join([*out, b[at:]]).decode("utf-8", "surrogatepass")


def strip(docs: DataFrame, threshold: int = 100) -> DataFrame:
    """docs, all columns kept, with the repeats cut out of text; texts of which nothing is left go."""
    placed, found, p = _found(docs, threshold)
    names = docs.columns
    placed = placed.withColumn("__tv_text", F.col("text"))

    def finish(docs: pa.Table, t: pa.Table) -> pa.Table:
        spans = merged(t.column("spans").to_pylist(), threshold)
        texts, stay = [], []
        for i, b, text in zip(ids_of(docs.column("__tv_id")).tolist(), bytes_of(docs.column("__tv_text")), docs.column("text").to_pylist()):
            gone = spans.get((i, tag_of(b)), []) if len(b) >= threshold else []
            texts.append(kept_text(b, gone) if gone else text)
            stay.append(not gone or bool(texts[-1]))
        k = docs.column_names.index("text")
        out = docs.set_column(k, docs.field(k), pa.chunked_array([pa.array(texts, docs.field(k).type)])).select(names)
        return out.filter(pa.array(stay, pa.bool_()))

    return placed.repartition(p, "__tv_bucket").groupBy("__tv_bucket").cogroup(found.repartition(p, "b").groupBy("b")).applyInArrow(finish, StructType(docs.schema.fields))
