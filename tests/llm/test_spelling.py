"""Spelling variants against comparing every two words."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

from edge import ODD, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from terravane.llm import spelling
from terravane.llm.queries import QUERIES


def counted(rows, every=199, letters=6, least=5):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(n, times=5):
    near, form, out = {w: [] for w in n}, {}, set()
    by_letters = {}
    for w in sorted(n):
        by_letters.setdefault(len(w), []).append(w)
    for w in n:
        near[w] = [v for k in (-1, 0, 1) for v in by_letters.get(len(w) + k, ()) if one_apart(w, v)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def rows_of(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", max_size=7), max_size=60))
def test_automaton(words):
    order = sorted(words)
    a = spelling.Automaton(order)
    assert all(a.walk(0, 0, w, 0) == k for k, w in enumerate(order))
    assert a.walk(0, 0, "abz", 0) == -1
    for w in order:
        want = {v for v in order if v.startswith(w[:2]) and len(v) in (len(w), len(w) - 1) and one_apart(w[2:], v[2:])}
        assert {order[k] for k in a.near(w, 2)} == want
    # Minimal: no two states have the same words ahead.
    ahead = {}

    def words_from(s):
        if s not in ahead:
            ahead[s] = frozenset({""} if a.final[s] else ()) | {c + x for c, t in a.next[s].items() for x in words_from(t)}
        return ahead[s]

    words_from(0)
    assert len(set(ahead.values())) == len(ahead)


def test_words_and_variants(spark, monkeypatch):
    r = random.Random(5)
    n = {"abcdef" * 700: 9, "a" * 9000: 70, "a" * 8999: 7, "a" * 9001: 7}
    for _ in range(60):
        w = "".join(r.choice("abc") for _ in range(r.randrange(6, 12)))
        for _ in range(20):
            k = r.randrange(len(w))
            v = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abcé") + w[k:], w[:k] + r.choice("abÿ") + w[k + 1 :]])
            if len(v) >= 6:
                n[v] = r.choice([5, 6, 25, 30, 150, 800])
        n[w] = 4000
    want = plain(n)
    words = spark.createDataFrame([(w, k, "x") for w, k in n.items()] + [(None, 3, "x")], "word string, n long, form string").repartition(3)
    assert rows_of(spelling.variants(words)) == want
    monkeypatch.setattr(spelling, "BLOCK", 5)
    assert rows_of(spelling.variants(words)) == want


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = [*ODD, (20, "Straße straße STRASSE straßen " * 9), (21, "colour color colours Color " * 30), (22, "ÀÉÎõü àéîõü " * 6)]
    docs = documents(spark, rows)
    for every in (199, 3):
        got = spelling.variants(spelling.word_counts(docs, every=every))
        assert rows_of(got) == plain(counted(rows, every))
    assert spelling.variants(spelling.word_counts(documents(spark, []))).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op12_spelling"](spark, sf)) == plain(counted(docs))
