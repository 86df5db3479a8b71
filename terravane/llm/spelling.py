"""Spelling variants: words one inserted, deleted or replaced letter apart, by forward and backward minimal automata.

An edit leaves one half of a word untouched. So a word w of m letters meets every near word that isn't longer either
among the words that begin with w's first m // 2 letters, or among those that end with its others. Spark deals
words out by such halves: as queries by their own two, as dictionary words by those that queries of their length, or of one letter
more, would have. A task builds a minimal acyclic automaton of its dictionary words, and one of them spelled backwards; states
know how many words they lead to, which numbers the words. A query walks its exact half and completes the rest with
one error; words that the other direction has found already, and repeated numbers, are dropped. Both ends of a
pair hear of it, as counts and best forms that are merged by word.

A half that very many words share is dealt out in blocks of dictionary words; its queries visit each block.

Edge cases: a null or empty text has no words; a null doc_id is written as nothing before the colon; rows that repeat a doc_id count
each; repeated rows of a table of words are added up; ties between forms go to the first word in code-point order; a word
without a form is its own root; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words of which a task holds counts at once.
HELD = 200_000
#: Dictionary words of one half in a block, and of all halves in a bucket.
BLOCK, BUCKET, LEAST_BUCKETS = 20_000, 20_000, 64


def run_counts(doc: int | None, text: str, every: int | None) -> Counter[str]:
    """Lower-cased runs of letters; of those whose crc32 with the doc_id is divisible by every, one letter goes."""
    runs = Counter(RUN.findall(text.translate(LOWER)))
    if every is None:
        return runs
    out: Counter[str] = Counter()
    head = b"" if doc is None else b"%d" % doc
    for run, n in runs.items():
        h = crc32(head + b":" + run.encode())
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def word_counts(docs: DataFrame, least_letters: int = 6, least_count: int = 5, every: int | None = None) -> DataFrame:
    """word, n: the words of that many letters and occurrences in all texts (doc_id, text)."""

    most = HELD

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            long = {w: n for w, n in held.items() if len(w) >= least_letters}
            return pa.RecordBatch.from_arrays([pa.array(list(long), pa.string()), pa.array(list(long.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                held.update(run_counts(doc, text.as_py() or "", every))
                if len(held) > most:
                    yield out()
                    held.clear()
        yield out()

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class Automaton:
    """Minimal acyclic automaton of distinct words in order; its numbers are their places in that order."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.final = [False]
        register: dict[tuple, int] = {}
        path, last = [0], ""  # states along the last word; those from the common prefix on are merged with equal ones

        def merge(upto: int) -> None:
            for k in range(len(path) - 1, upto, -1):
                s = path[k]
                same = register.setdefault((self.final[s], *self.next[s].items()), s)
                if same != s:
                    self.next[path[k - 1]][last[k - 1]] = same
                    free.append(s)
            del path[upto + 1 :]

        free: list[int] = []
        for w in words:
            shared = 0
            while shared < min(len(w), len(last)) and w[shared] == last[shared]:
                shared += 1
            merge(shared)
            for c in w[shared:]:
                if free:
                    s = free.pop()
                    self.next[s], self.final[s] = {}, False
                else:
                    s = len(self.next)
                    self.next.append({})
                    self.final.append(False)
                self.next[path[-1]][c] = s
                path.append(s)
            self.final[path[-1]] = True
            last = w
        merge(0)
        # Words before each transition: those that end in the state, then those through the transitions before it.
        self.skip: list[dict[str, int]] = [{} for _ in self.next]
        size: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            todo = [t for t in self.next[s].values() if t not in size]
            if todo:
                stack += todo
                continue
            stack.pop()
            if s not in size:
                n = int(self.final[s])
                for c, t in self.next[s].items():
                    self.skip[s][c] = n
                    n += size[t]
                size[s] = n

    def walk(self, s: int, number: int, w: str, at: int) -> int:
        """Number of the word that w[at:] completes from state s, or -1."""
        step, skip = self.next, self.skip
        for k in range(at, len(w)):
            c = w[k]
            t = step[s].get(c)
            if t is None:
                return -1
            number += skip[s][c]
            s = t
        return number if self.final[s] else -1

    def near(self, w: str, exact: int) -> set[int]:
        """Numbers of the words that begin with w[:exact] and have one letter replaced or none for one later on."""
        step, skip = self.next, self.skip
        s = number = 0
        for c in w[:exact]:
            t = step[s].get(c)
            if t is None:
                return set()
            number += skip[s][c]
            s = t
        found = set()
        for k in range(exact, len(w)):
            here = w[k]
            if k + 1 == len(w) or w[k + 1] != here:  # of a repeated letter any one may go
                found.add(self.walk(s, number, w, k + 1))
            for c, t in step[s].items():
                if c != here:
                    found.add(self.walk(t, number + skip[s][c], w, k + 1))
            t = step[s].get(here)
            if t is None:
                break
            number += skip[s][here]
            s = t
        found.discard(-1)
        return found


def bucket_pairs(group: list[int], backward: list[bool], query: list[bool], word: list[str]) -> Iterator[tuple[str, str]]:
    """(query, near word that isn't longer) of one bucket's rows, each pair once over both directions and all blocks."""
    dealt = {(g, w) for g, q, w in zip(group, query, word) if not q}
    for side in (False, True):
        turn = (lambda w: w[::-1]) if side else (lambda w: w)
        known = sorted({turn(w) for b, q, w in zip(backward, query, word) if b == side and not q})
        asked = {(g, w) for g, b, q, w in zip(group, backward, query, word) if b == side and q}
        if not known or not asked:
            continue
        automaton = Automaton(known)
        for g, w in asked:
            half = len(w) // 2
            for k in automaton.near(turn(w), len(w) - half if side else half):
                v = turn(known[k])
                # Other halves' words are in the automaton, too; they may be dealt to other buckets as well.
                if (g, v) in dealt and not (side and v.startswith(w[:half])):
                    yield w, v


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form, form_n for words (word, n, distinct, read more than once) with near words; form: the most frequent one."""
    size, half = F.length("word"), lambda m: F.floor(m / 2).cast("int")
    entry = lambda back, ask, m: F.struct(
        F.lit(back).alias("back"), F.lit(ask).alias("ask"), m.alias("m"),
        (F.substr("word", half(m) + size - m + 1, m - half(m)) if back else F.substr("word", F.lit(1), half(m))).alias("half"),
    )
    entries = [entry(back, ask, m) for back in (False, True) for ask, m in ((True, size), (False, size), (False, size + 1))]
    dealt = words.select("word", "n", F.explode(F.array(*entries)).alias("e")).select("word", "n", "e.*")
    shares = dealt.filter("not ask").groupBy("back", "m", "half").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).filter("blocks > 1")
    split = dealt.join(shares, ["back", "m", "half"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.when(F.col("ask"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("blocks"))))
    count = max(LEAST_BUCKETS, 4 * words.count() // BUCKET)
    placed = split.withColumn("block", F.explode(block)).select("word", "n", "back", "ask", F.xxhash64("back", "m", "half", "block").alias("group"))
    placed = placed.withColumn("bucket", F.pmod("group", F.lit(count)))

    def search(t: pa.Table) -> pa.Table:
        word = t.column("word").to_pylist()
        n = dict(zip(word, t.column("n").to_pylist()))
        held: dict[str, list] = {}
        for w, v in bucket_pairs(t.column("group").to_pylist(), t.column("back").to_pylist(), t.column("ask").to_pylist(), word):
            # Words of one length ask for each other.
            for a, b in ((w, v),) if len(v) == len(w) else ((w, v), (v, w)):
                x = held.setdefault(a, [0, n[b], b])
                x[0] += 1
                if (-n[b], b) < (-x[1], x[2]):
                    x[1:] = n[b], b
        return pa.table({
            "word": pa.array(list(held), pa.string()), "n_near": pa.array([x[0] for x in held.values()], pa.int64()),
            "form_n": pa.array([x[1] for x in held.values()], pa.int64()), "form": pa.array([x[2] for x in held.values()], pa.string()),
        })

    found = placed.groupBy("bucket").applyInArrow(search, "word string, n_near long, form_n long, form string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame, rounds: int = 60) -> DataFrame:
    """word, root: where the forms (word, form) lead to in the end; a step raises the count, so there are no circles."""
    far = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        jump = far.select(F.col("word").alias("via"), F.col("root").alias("end"))
        new = cut(far.join(jump, F.col("root") == F.col("via"), "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")))
        moved, far = not new.filter("moved").isEmpty(), new.drop("moved")
        if not moved:
            return far
    raise RuntimeError("forms did not settle")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n): the form is the most frequent near word, if it occurs that many times as often."""
    words = cut(words.filter("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = cut(words.join(near_words(words), "word", "left").withColumn("holds", F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))))
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(F.col("holds"), F.col(c)).alias(c) for c in ("form", "form_n")))
    ends = roots(near.filter("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
