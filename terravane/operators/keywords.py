"""Registers of keywords against texts: one pass over each text for all keywords, whatever their number.

The keywords make one automaton (a trie with failure links), kept as packed arrays and sent to the tasks; a batch of
texts is cut into chunks that walk it in step, so the time is in proportion to the letters, not to letters times
keywords. A register beyond MOST letters isn't sent anywhere: it meets the texts in an equality join on
letter groups (operators/containing.py), with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.operators.containing import containing

#: Letters of all keywords that one automaton holds; some twenty bytes each, in every task.
MOST = 4_000_000
#: Letters of a chunk, and of the texts that walk at once.
CHUNK, TOGETHER = 256, 1 << 20
#: Stands between texts; no letter.
GAP = 0x110000


class Automaton:
    """All distinct keywords at once: finds which of them occur in each of many texts.

    States are numbered level by level, and edges are sorted by (state, letter), so the edge at place k leads to
    state k + 1: the sorted edges are the whole trie.
    """

    def __init__(self, words: Sequence[str], alone: Sequence[bool] | None = None):
        self.size = np.array([len(w) for w in words], np.int64)
        self.alone = np.zeros(len(words), bool) if alone is None else np.array(alone, bool)
        letters, start = codes(words), np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.longest = int(self.size.max()) if len(words) else 0
        state, levels, total = np.zeros(len(words), np.int64), [], 1
        for depth in range(self.longest):
            live = np.flatnonzero(self.size > depth)
            edges, of = np.unique(state[live] << 21 | letters[start[live] + depth], return_inverse=True)
            state[live] = total + of
            levels.append(edges)
            total += len(edges)
        self.edges = np.concatenate(levels) if levels else np.zeros(0, np.int64)
        self.word = np.full(total, -1, np.int32)
        self.word[state] = np.arange(len(words), dtype=np.int32)
        self.first = np.zeros(GAP + 1, np.int32)
        if levels:
            self.first[levels[0] & 0x1FFFFF] = np.arange(1, len(levels[0]) + 1)
        self.fail, self.link = np.zeros(total, np.int32), np.zeros(total, np.int32)
        at = 1
        for depth, edges in enumerate(levels):
            new = np.arange(at, at + len(edges))
            if depth:
                self.fail[new] = self.step(self.fail[edges >> 21], edges & 0x1FFFFF)
            back = self.fail[new]
            self.link[new] = np.where(self.word[back] >= 0, back, self.link[back])
            at += len(edges)
        self.ends = (self.word >= 0) | (self.link > 0)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after a letter; where there is no edge, those of the longest suffix that has one."""
        state, out = state.astype(np.int64), np.zeros(len(state), np.int32)
        todo = np.flatnonzero(state)
        while len(todo):
            want = state[todo] << 21 | letter[todo]
            at = np.minimum(np.searchsorted(self.edges, want), len(self.edges) - 1)
            hit = self.edges[at] == want
            out[todo[hit]] = at[hit] + 1
            todo = todo[~hit]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] > 0]
        rest = (state == 0) & (out == 0)
        out[rest] = self.first[letter[rest]]
        return out

    def found(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, keyword) places of what occurs, each pair once, in order."""
        pairs = [np.zeros(0, np.int64)]
        size = np.array([len(x or "") for x in texts], np.int64)
        for a, b in batches(size, TOGETHER):
            text, word = self.occurrences([x or "" for x in texts[a:b]], size[a:b])
            pairs.append(np.unique((text + a) * len(self.size) + word))
        flat = np.concatenate(pairs)
        return flat // max(1, len(self.size)), flat % max(1, len(self.size))

    def occurrences(self, texts: Sequence[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.size) or not size.sum():
            return none
        step, before = max(CHUNK, self.longest), self.longest - 1
        # A gap before each text, in which the chunk before the first letter lies.
        begin = np.cumsum(np.concatenate([[0], size[:-1] + step])) + step
        flat = np.full(int(begin[-1] + size[-1]) + step, GAP, np.int64)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(begin, size) + inner] = codes(texts)
        count = -(-size // step)
        chunk = np.repeat(begin, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
        of = np.repeat(np.arange(len(texts)), count)
        state, ends, at_end = np.zeros(len(chunk), np.int32), [none[0]], [none[0]]
        who = [none[0]]
        for k in range(-before, step):
            state = self.step(state, flat[chunk + k])
            if k >= 0:
                hit = np.flatnonzero(self.ends[state])
                if len(hit):
                    who.append(of[hit])
                    at_end.append(chunk[hit] + k)
                    ends.append(state[hit].astype(np.int64))
        text, place, state = np.concatenate(who), np.concatenate(at_end), np.concatenate(ends)
        found = []
        while len(state):
            word = self.word[state]
            ok = word >= 0
            w = word[ok]
            letter = lambda x: (x >= 97) & (x <= 122)
            joined = letter(flat[place[ok] - self.size[w]]) | letter(flat[place[ok] + 1])
            fits = ~(self.alone[w] & joined)
            found.append((text[ok][fits], w[fits].astype(np.int64)))
            state = self.link[state].astype(np.int64)
            more = state > 0
            text, place, state = text[more], place[more], state[more]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else none


def codes(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def batches(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many letters, one text at least."""
    a = held = 0
    for k, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield a, k
            a, held = k, 0
        held += n + CHUNK
    if len(size) > a:
        yield a, len(size)


def owners_found(rows: DataFrame, keywords: DataFrame, first: bool = False, most: int = MOST) -> DataFrame:
    """rows and owner: each owner once a row, of whose keywords one occurs in the row's column that the keyword names.

    keywords: field (a column of rows), keyword, alone (no letter a-z may touch it), owner (long). Texts and keywords are
    compared as they are; blank keywords and null texts match nothing. first: the least owner only.
    Rows that are alike are kept apart within MOST letters, and beyond it, too, if they differ in any column.
    """
    known = keywords.filter("keyword <> '' and owner is not null").select("field", "keyword", "alone", "owner").distinct()
    letters = known.agg(F.sum(F.length("keyword"))).first()[0] or 0
    if letters > most:
        return _joined(rows, known, first)
    table = known.toArrow()  # within the checked size
    fields, words, alone, owners = (table.column(c).to_pylist() for c in ("field", "keyword", "alone", "owner"))
    distinct = sorted(set(zip(words, alone)))
    place = {w: k for k, w in enumerate(distinct)}
    automaton = Automaton([w for w, _ in distinct], [a for _, a in distinct])
    at = {c: rows.columns.index(c) for c in sorted(set(fields))}
    meant = {}
    for c in at:
        mine = sorted((place[w, a], o) for f, w, a, o in zip(fields, words, alone, owners) if f == c)
        meant[c] = np.array([x for x, _ in mine], np.int64), np.array([o for _, o in mine], np.int64)
    sent = rows.sparkSession.sparkContext.broadcast((automaton, meant))

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, meant = sent.value
        for b in parts:
            row, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for c, (word, whose) in meant.items():
                text, hit = automaton.found(b.column(at[c]).to_pylist())
                a, z = np.searchsorted(word, hit), np.searchsorted(word, hit, side="right")
                each = z - a
                row.append(np.repeat(text, each))
                owner.append(whose[np.repeat(a, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)])
            pair = np.unique(np.rec.fromarrays([np.concatenate(row), np.concatenate(owner)], names="row,owner"))
            if first and len(pair):
                pair = pair[np.append(True, pair["row"][1:] != pair["row"][:-1])]
            out = b.take(pa.array(pair["row"]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(pair["owner"])], [*b.schema.names, "owner"])

    return rows.mapInArrow(scan, rows.select("*", F.lit(0).cast("long").alias("owner")).schema)


def _joined(rows: DataFrame, known: DataFrame, first: bool) -> DataFrame:
    """The same by equality joins, for registers that are not to be sent to tasks."""
    found = rows.select("*", F.lit(0).cast("long").alias("owner")).limit(0)
    for c in sorted(r.field for r in known.select("field").distinct().collect()):  # names of columns
        own = known.filter(F.col("field") == c)
        texts = rows.filter(F.col(c).isNotNull()).select(F.col(c).alias("text")).distinct()
        pairs = containing(texts, own.select(F.col("keyword").alias("part")).distinct())
        hits = pairs.join(own, F.col("part") == F.col("keyword"))
        hits = hits.filter(~F.col("alone") | stands_alone(F.col("text"), F.col("keyword"))).select("text", "owner").distinct()
        found = found.unionByName(rows.join(hits, F.col(c) == F.col("text")).select(*rows.columns, "owner"))
    return found.groupBy(*rows.columns).agg(F.min("owner").alias("owner")) if first else found.distinct()


def stands_alone(text: Column, keyword: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit("(?<![a-z])\\Q"), keyword, F.lit("\\E(?![a-z])")))


def short_ones(keyword: Column, mode: str) -> Column:
    """Which keywords must stand alone: in mode "boundary" those of up to three letters."""
    return F.length(keyword) <= 3 if mode == "boundary" else F.lit(False)
