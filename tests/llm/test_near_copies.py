"""The near-dedup stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import corpus_pipeline
from edge import ODD, documents

from terravane.llm import near_copies


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    """Brute force: the least (doc_id, text) of each component."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if group[a] != group[b] and (x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) / len(x | y) >= 0.8):
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for g, (d, _) in zip(group, rows):
        best[g] = min(best.get(g, (True, 0)), (d is None, d or 0))
    return sorted(best.values())


def kept(out):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept(out) == survivors([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TILE", 4)
    r = random.Random(3)
    rows = list(ODD)
    for k in range(6):
        w = [f"w{r.randrange(10**6)}" for _ in range(120)]
        for m in range(10):
            v = list(w)
            for _ in range(r.randrange(0, 7)):
                v[r.randrange(len(v))] = f"x{r.randrange(10**6)}"
            rows.append((100 * k + 50 + m if m % 3 else None, " ".join(v)))
    docs = documents(spark, rows)
    out = near_copies.keep_first(docs)
    assert out.schema == docs.schema
    assert kept(out) == survivors(rows)
