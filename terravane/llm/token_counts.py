"""Token counts with a whole-token shortcut.

Offline, every string of the vocabulary that is a pre-token is merged once; those that end as a single
token are proven whole. A pre-token of the corpus among them counts one without any merge, and only the
rest is merged.

Edge cases: a null or empty text has no bytes and no tokens; special strings count one each; texts of any
length are counted whole; repeated rows give repeated results; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_bpe import Remembered, WordBpe


def whole_tokens(bpe: WordBpe) -> frozenset[str]:
    """The pre-tokens that encode alone as one token; at most the size of the vocabulary."""
    back = {c: b for b, c in enumerate(bpe.letters)}
    found = []
    for s in bpe.vocab:
        if s.endswith(bpe.end) and len(s) > len(bpe.end):
            try:
                word = bytes(back[c] for c in s[: -len(bpe.end)]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if bpe.words(word) == [word] and bpe.tokens(word) == [s]:
                found.append(word)
    return frozenset(found)


class Counter:
    def __init__(self, path: str, whole: frozenset[str] | None = None) -> None:
        self.bpe = WordBpe(path)
        self.whole = whole_tokens(self.bpe) if whole is None else whole
        self.known = Remembered(self.chunk)

    def chunk(self, chunk: str) -> int:
        if chunk in self.whole:
            return 1
        return sum(1 if w in self.whole else len(self.bpe.tokens(w)) for w in self.bpe.words(chunk))

    def count(self, text: str) -> int:
        chunks, special = self.bpe.parts(text)
        return sum(map(self.known.__getitem__, chunks)) + len(special)


_counters: dict[str, Counter] = {}


def counter(path: str, whole: frozenset[str] | None = None) -> Counter:
    """One for each Python worker and vocabulary; whole: what is proven already."""
    if path not in _counters:
        _counters[path] = Counter(path, whole)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document; path: the vocabulary file, on every machine.

    The proof is made once, before any text is read, and sent to the workers: it is no larger than the vocabulary.
    """
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(WordBpe(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, proven.value)
        for b in batches:
            n = pa.array([c.count(t.as_py() or "") for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = docs.select(F.col("doc_id").cast("long"), size.alias("n_bytes"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
