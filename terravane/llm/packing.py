"""Packing of token sequences: dominance reduction after Martello and Toth, then best fit.

Only the number of pieces of each length matters, so the driver sees a histogram of at most `capacity`
rows, however large the corpus. Reduction and best fit work on it with multiplicities and give patterns
(lengths of one sequence, how often); ranks within a length, counted in salted groups, then tell each
piece its pattern.

Edge cases: a null or empty text is its end token alone; only texts longer than a sequence are cut; a null
doc_id is packed like any other; repeated rows are packed each; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .word_bpe import WordBpe

#: Pieces in each group whose ranks one task counts.
GROUP = 200_000
#: Documents whose new chunks go to the tokenizer together, and chunks in each text for it.
TOGETHER, CHUNKS = 256, 200
#: Remembered chunks per Python worker, some 200 bytes each.
REMEMBERED_HERE = 800_000


class Encoder:
    """Ids as little-endian bytes; each chunk goes through the tokenizers library once.

    New chunks go there many to a text, and the ends of words among their ids tell them apart again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers

        self.bpe = WordBpe(path)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # special strings are cut out before; what is left is text
        self.library.normalizer = normalizers.Sequence([])  # chunks are normalised; twice could compose more characters
        self.known: dict[str, bytes] = {}
        self.ends = np.zeros(self.library.get_vocab_size(), np.int64)
        self.ends[[k for s, k in self.bpe.vocab.items() if s.endswith(self.bpe.end)]] = 1

    def remember(self, new: list[str]) -> None:
        parts = [new[k : k + CHUNKS] for k in range(0, len(new), CHUNKS)]
        for part, e in zip(parts, self.library.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            words = np.cumsum([1 if c.isalpha() and self.bpe.agreed(c) else len(self.bpe.words(c)) for c in part])
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == words[-1]:
                at = [0, *(4 * (ends[words - 1] + 1)).tolist()]
                b = ids.tobytes()
                self.known.update(zip(part, map(b.__getitem__, map(slice, at, at[1:]))))
            else:  # the library splits some chunk in another way than its pattern says
                for c, x in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                    self.known[c] = np.array(x.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        special = {s: k.to_bytes(4, "little") for s, k in self.bpe.special.items()}
        split: list[list[str]] = []
        chunks = self.bpe.chunks
        marks: dict[int, list[tuple[int, bytes]]] = {}
        for k, t in enumerate(texts):
            if "<" in t and self.bpe.specials.search(t):
                split.append([])
                at = 0
                for m in self.bpe.specials.finditer(t):
                    split[k] += chunks(t[at : m.start()])
                    marks.setdefault(k, []).append((len(split[k]), special[m[0]]))
                    at = m.end()
                split[k] += chunks(t[at:])
            else:
                split.append(chunks(t))
        new = list(set().union(*split).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED_HERE:
            self.known.clear()
            new = list(set().union(*split))
        self.remember(new)
        out = []
        for k, s in enumerate(split):
            found = list(map(self.known.__getitem__, s))
            for at, mark in reversed(marks.get(k, ())):
                found.insert(at, mark)
            out.append(b"".join(found))
        return out


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids (four bytes each, little-endian) of every document's pieces."""
    schema = "doc_id long, piece int, start long, length long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, last, step = encoder(path), end.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), e.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += last
                    for p, at in enumerate(range(0, len(ids), step)):
                        x = ids[at : at + step]
                        rows.append((doc, p, at // 4, len(x) // 4, x))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Pattern(NamedTuple):
    lengths: tuple[int, ...]
    times: int


def reduced(count: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that some optimal packing has, and what they leave.

    The longest piece goes with the longest other piece that fits wherever that partner dominates: no set of
    pieces that fits beside the longest one has a greater sum, so any such set can change places with it.
    """
    left = {s: n for s, n in count.items() if n}
    sizes = sorted(left)
    fixed: list[Pattern] = []
    for j in sorted(left, reverse=True):
        while left.get(j):
            free = capacity - j
            k = bisect_left(sizes, free + 1) - 1
            while k >= 0 and sizes[k] == j and left[j] < 2:
                k -= 1
            if k < 0:
                fixed.append(Pattern((j,), left.pop(j)))
                sizes.remove(j)
                break
            a = sizes[k]
            if a < free:
                reach, mask = 1, (1 << (free + 1)) - 1
                for s in sizes[: k + 1]:
                    for _ in range(min(left[s] - (s == j), free // s)):
                        reach |= (reach << s) & mask
                    if reach >> (a + 1):
                        break
                if reach >> (a + 1):
                    break  # not dominated; left to best fit
            times = left[j] // 2 if a == j else min(left[j], left[a])
            fixed.append(Pattern((j, a), times))
            for s in (j, a):
                left[s] -= times
                if not left[s]:
                    del left[s]
                    sizes.remove(s)
    return fixed, left


def best_fit(count: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing with multiplicities: open sequences are kept by what they have left."""
    rooms: list[int] = []
    open_: dict[int, list[Pattern]] = {}

    def put(p: Pattern) -> None:
        room = capacity - sum(p.lengths)
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(p)

    for s in sorted(count, reverse=True):
        n = count[s]
        while n:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                each = capacity // s
                if n >= each:
                    put(Pattern((s,) * each, n // each))
                if n % each:
                    put(Pattern((s,) * (n % each), 1))
                break
            room = rooms[k]
            p = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            each = min(room // s, n)
            times = min(p.times, n // each)
            put(Pattern((*p.lengths, *(s,) * each), times))
            if times < p.times:
                put(Pattern(p.lengths, p.times - times))
            n -= each * times
    return [p for ps in open_.values() for p in ps]


def plan(count: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, left = reduced(count, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset): where the pieces of a length go."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for p in patterns:
        at = 0
        for s in p.lengths:
            r = rank.get(s, 0)
            out.append((s, r, r + p.times, sequence, at))
            rank[s] = r + p.times
            at += s
        sequence += p.times
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset; pieces: rows with length, read more than once."""
    spark = pieces.sparkSession
    groups = max(8, pieces.count() // GROUP)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    counted = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    count = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # capacity rows at most
    if count and not 0 < min(count) <= max(count) <= capacity:
        raise ValueError("pieces must have lengths from 1 to the capacity")
    where = spark.createDataFrame(slots(plan(count, capacity)), "length long, __from long, __to long, __sequence long, offset long")
    earlier = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "__salt", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("__own", own).join(base, ["length", "__salt"]).withColumn("__rank", F.col("__own") + F.col("__base"))
    # Each pattern uses up a length or splits another one once, so the slots are bounded by the capacity, not the corpus.
    fits = (ranked["length"] == where["length"]) & (ranked["__rank"] >= where["__from"]) & (ranked["__rank"] < where["__to"])
    placed = ranked.join(F.broadcast(where), fits).drop(where["length"])
    return placed.select(*pieces.columns, (F.col("__sequence") + F.col("__rank") - F.col("__from")).alias("sequence_id"), "offset")


def packed(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """pieces with their token ids, CRC of these, sequence_id and offset: a sequence is its pieces' ids by offset."""
    placed = pack(stored(pieces(docs, path, capacity, end), "pieces"), capacity)
    return placed.withColumn("ids_crc32", F.crc32("ids"))
