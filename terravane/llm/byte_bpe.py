"""Byte-level BPE by ranks, with a hierarchical bitmap as the queue of merges.

Each merge rank has a bucket of positions; a two-level bitmap tells which buckets hold any, and
find-first-set gives the least. Positions are linked both ways; an entry whose pair has changed since it
was queued is stale and skipped. Every step costs the same whatever the length of the pre-token.

Short pre-tokens share one queue, many at a time: of each rank's bucket the leftmost position of every
pre-token is merged at once, as pre-tokens don't touch each other. Long ones have a queue each.

The pattern's character classes are those of the tiktoken library, whose Unicode version is not that of the
module regex: characters of which the two think otherwise are matched by stand-ins of the right classes.

Edge cases: a null or empty text has no ids; special strings are text; texts of any length are encoded
whole; repeated rows give repeated results; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_bpe import Remembered

#: White space runs that a cut before a space could tear apart.
_torn = re.compile("\\s (?:\\s|$)").search
#: Bits of a bitmap word, as a power of two.
WORD = 8
#: Bytes from which a pre-token has a queue of its own.
LONG = 64
#: Bytes of text whose new pre-tokens are merged together.
TOGETHER = 16 << 20
#: Remembered chunks per Python worker, some 350 bytes each.
REMEMBERED_HERE = 700_000


class RankQueue:
    """Buckets of positions by rank, under a two-level bitmap."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}  # bitmap words, by their number
        self.high = 0  # bitmap of the words that are not zero

    def bucket(self, r: int) -> list[int]:
        """A new bucket."""
        w = r >> WORD
        self.low[w] = self.low.get(w, 0) | 1 << (r & 255)
        self.high |= 1 << w
        self.buckets[r] = b = []
        return b

    def put(self, r: int, k: int) -> None:
        (self.buckets.get(r) or self.bucket(r)).append(k)

    def pop(self) -> tuple[int, list[int]]:
        """The least rank, by find-first-set, and its positions."""
        w = (self.high & -self.high).bit_length() - 1
        bits = self.low[w]
        rest = bits & (bits - 1)
        self.low[w] = rest
        if not rest:
            self.high ^= 1 << w
        r = w << WORD | (bits ^ rest).bit_length() - 1
        return r, self.buckets.pop(r)


def stand_ins(pattern: str) -> dict[str, str]:
    """ASCII characters for those that the module regex has in other classes of the pattern than tiktoken has."""
    import tiktoken

    bytes_alone = {bytes([b]): b for b in range(256)}
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    own, theirs = [], []
    for name in sorted(set(regex.findall(r"\\[pP]\{\w+\}|\\[sSwWdD]", pattern))):
        found = tiktoken.Encoding(name, pat_str=f"{name}+", mergeable_ranks=bytes_alone, special_tokens={}).encode_ordinary(every)
        theirs.append(frozenset(bytes(found).decode()))
        own.append(frozenset("".join(regex.findall(f"{name}+", every))))
    classes = lambda c, of: tuple(c in x for x in of)
    ascii_of = {classes(c, own): c for c in map(chr, range(9, 127)) if c not in pattern}
    return {c: ascii_of[classes(c, theirs)] for c in set().union(*(a ^ b for a, b in zip(own, theirs)))}


class ByteBpe:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {k: b for b, k in self.ranks.items()}
        self.digits = {k: str(k) for k in self.bytes}
        self.match = regex.compile(pattern)
        self.stand_ins = stand_ins(pattern)
        self.table = str.maketrans(self.stand_ins)
        self.known: dict[str, tuple[str, bytes]] = {}
        self.words = Remembered(self.word, 200_000)
        self.none = max(self.bytes) + 1  # in the place of a neighbour where there is none
        parts = [(self.ranks[b[:k]] * (self.none + 1) + self.ranks[b[k:]], r) for b, r in self.ranks.items() for k in range(1, len(b)) if b[:k] in self.ranks and b[k:] in self.ranks]
        parts.append((1 << 62, -1))
        pairs = np.array(sorted(parts), np.int64)
        self.pairs, self.made = np.ascontiguousarray(pairs[:, 0]), pairs[:, 1].astype(np.int32)
        self.single = np.array([self.ranks.get(bytes([b]), self.none) for b in range(256)], np.int64)

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text.isascii() or self.stand_ins.keys().isdisjoint(text):
            return self.match.findall(text)
        shown = text.translate(self.table)
        return [text[m.start() : m.end()] for m in self.match.finditer(shown)]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of neighbouring ids, or -1."""
        key = a * (self.none + 1) + b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.made[at], -1)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token of any length."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        n, rank = len(word), ranks.get
        start, after, before = list(range(n + 1)), list(range(1, n + 2)), list(range(-1, n))
        queued: list[int | None] = [None] * n  # the rank under which a position's pair counts
        queue = RankQueue()
        for k in range(n - 1):
            r = rank(word[k : k + 2])
            if r is not None:
                queued[k] = r
                queue.put(r, k)
        while queue.high:
            r, bucket = queue.pop()
            bucket.sort()  # from left to right; a merge never queues its own rank again to the left
            for i, k in enumerate(bucket):
                if queued[k] != r:
                    continue
                j = after[k]
                end = after[j]
                after[k] = end
                queued[j] = None
                if end <= n:
                    before[end] = k
                lower = False
                for x in (before[k], k):
                    if x < 0:
                        continue
                    mid = after[x]
                    new = rank(word[start[x] : start[after[mid]]]) if mid < n else None
                    queued[x] = new
                    if new is not None:
                        queue.put(new, x)
                        lower |= new < r
                if lower:  # goes first; the others of this rank wait
                    for x in bucket[i + 1 :]:
                        queue.put(r, x)
                    break
        out, k = [], 0
        while k < n:
            out.append(ranks[word[k : after[k]]])
            k = after[k]
        return out

    def merge_many(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """(ids of all words, where each word's ids end) of words that are not empty, by one queue for all."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends, n = np.cumsum(sizes), int(sizes.sum())
        ids = np.append(self.single[np.frombuffer(b"".join(words), np.uint8)], self.none)  # the last place stands for no neighbour
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[ends - sizes] = n, n
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        queued = np.append(self.pair_ranks(ids[:-1], ids[after[:-1]]), -1)
        first = np.argsort(queued, kind="stable")
        first = first[np.searchsorted(queued[first], 0) :].astype(np.int32)
        queue = RankQueue()
        cuts = np.flatnonzero(np.diff(queued[first], prepend=-1))
        whole = {}  # what the buckets hold to begin with
        for r, a, b in zip(queued[first[cuts]].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(first)]):
            queue.bucket(r)
            whole[r] = first[a:b]
        buckets, bucket = queue.buckets, queue.bucket
        while queue.high:
            r, late = queue.pop()
            k = whole.pop(r, None)
            if late:
                late = np.array(late, np.int32)
                k = np.unique(late if k is None else np.concatenate([k, late]))
            k = k[queued[k] == r]
            if not len(k):
                continue
            if len(k) > 1:
                w = word[k]
                again = w[1:] == w[:-1]
                if again.any():  # only the leftmost of each word; the others wait
                    again = np.append(False, again)
                    bucket(r)
                    whole[r], k = k[again], k[~again]
            j, b = after[k], before[k]
            e = after[j]
            left, right = ids[b], ids[e]
            ids[k], ids[j], queued[j] = r, -1, -1
            after[k], before[e] = e, k
            x, same = np.concatenate([b, k]), np.full(len(k), r)
            new = self.pair_ranks(np.concatenate([left, same]), np.concatenate([same, right]))
            queued[x] = new
            has = np.flatnonzero(new >= 0)
            for y, at in zip(new[has].tolist(), x[has].tolist()):
                if y in buckets:
                    buckets[y].append(at)
                else:
                    bucket(y).append(at)
        left = ids[:-1] >= 0
        return ids[:-1][left].tolist(), np.cumsum(left)[ends - 1].tolist()

    def word(self, word: str) -> list[int]:
        return self.merge(word.encode("utf-8", "surrogatepass"))

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        out, short = {}, []
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if b in self.ranks:
                out[w] = [self.ranks[b]]
            elif len(b) > LONG:
                out[w] = self.merge(b)
            else:
                short.append((w, b))
        if short:
            ids, ends = self.merge_many([b for _, b in short])
            for (w, _), a, e in zip(short, [0, *ends], ends):
                out[w] = ids[a:e]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def chunks(self, text: str) -> list[str]:
        """The text's pre-tokens, or larger parts that have the same pre-tokens apart as together."""
        if _torn(text):
            return self.find(text)
        first, *rest = text.split(" ")
        return [*([first] if first else []), *map(" ".__add__, rest)]

    def encode(self, text: str) -> list[int]:
        return [k for w in self.find(text) for k in self.words[w]]

    def remember(self, texts: list[str]) -> None:
        """Encode the chunks of the texts that are not known yet, and decode their ids."""
        new: set[str] = set()
        for t in texts:
            new.update(self.chunks(t))
        if len(new) + len(self.known) > REMEMBERED_HERE:
            self.known = {c: self.known[c] for c in new if c in self.known}
        new.difference_update(self.known)
        parts = {c: self.find(c) for c in new}
        ids = self.encode_words(set().union(*parts.values()))
        for c, words in parts.items():
            own = ids[words[0]] if len(words) == 1 else [k for w in words for k in ids[w]]
            self.known[c] = ",".join(map(self.digits.__getitem__, own)), self.decode(own)

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded bytes) of a remembered text."""
        parts = self.chunks(text)
        if not parts:
            return 0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest()
        ids, back = zip(*map(self.known.__getitem__, parts))
        listed = ",".join(ids)
        return listed.count(",") + 1, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b"".join(back)).hexdigest()

    def all_digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        held: list[str] = []
        size = 0
        gc.disable()  # what is made here has no cycles, and collections would visit all that is remembered
        try:
            for t in texts:
                held.append(t)
                size += len(t)
                if size >= TOGETHER:
                    self.remember(held)
                    yield from map(self.digests, held)
                    held, size = [], 0
            self.remember(held)
            yield from map(self.digests, held)
        finally:
            gc.enable()


@cache
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every document; path: the rank file, on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            ids = pa.array([bpe.encode(t.as_py() or "") for t in b.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); bytes that are no UTF-8 become U+FFFD, a null list an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            text = [bpe.decode(ids.as_py() or ()).decode("utf-8", "replace") for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded from the ids, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            n, ids, back = zip(*bpe.all_digests(t.as_py() or "" for t in b.column(1))) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
