from __future__ import annotations

import random

import numpy as np
import xxhash
from edge import ODD, documents

from terravane.llm import simhash


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=2):
    """Brute force: smallest index of each component."""
    label = list(range(len(fps)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(fps))]


def test_fingerprints():
    for _, t in ODD:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint("One two THREE\u00a0four") == plain_fingerprint("one two three\u00a0four")


def near(r, n, flips):
    base = [r.getrandbits(64) for _ in range(n)]
    out = list(base)
    for x in base:
        for _ in range(r.randint(0, 6)):
            for b in r.sample(range(64), r.randint(0, flips)):
                x ^= 1 << b
            out.append(x)
    return sorted(set(out))


def test_links_and_components(spark):
    r = random.Random(1)
    fps = near(r, 300, 3)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {x.node: x.label for x in simhash.components(simhash.links(df)).collect()}
    want, by = groups(fps), {}
    for k, g in enumerate(want):
        by.setdefault(g, []).append(signed[k])
    assert {frozenset(v) for v in by.values() if len(v) > 1} == {frozenset(n for n in got if got[n] == label) for label in set(got.values())}
    assert all(got[n] == min(v) for v in by.values() if len(v) > 1 for n in v)


def test_tree_prunes_exactly():
    r = random.Random(2)
    x = np.array(near(r, 1500, 2), np.uint64)
    old, simhash.LEAF = simhash.LEAF, 1000
    try:
        found = {(int(a), int(b)) for p, q in simhash.leaf_pairs(x, x, np.arange(len(x)), np.arange(len(x)), 2) for a, b in zip(p, q)}
    finally:
        simhash.LEAF = old
    assert found == {(int(a), int(b)) for a, b in np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2)}


def test_odd_documents(spark):
    rows = simhash.classes(documents(spark, ODD)).collect()
    fps = [simhash.fingerprint(t) for _, t in ODD]
    want = groups(fps)
    assert len(rows) == len(ODD)
    smallest = {}
    for (d, _), g in zip(ODD, want):
        if d is not None:
            smallest[g] = min(smallest.get(g, d), d)
    key = lambda d, f, c: (str(d), f, str(c))
    assert sorted(key(r.doc_id, r.fp % 2**64, r.component_id) for r in rows) == sorted(key(d, f, smallest.get(g)) for (d, _), f, g in zip(ODD, fps, want))


def test_empty_table(spark):
    assert simhash.classes(documents(spark, []).limit(0)).collect() == []


def test_chain_settles(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    assert {r.label for r in simhash.components(edges).collect()} == {0}


def brute(signed, radius):
    by = {}
    for k, g in enumerate(groups([x % 2**64 for x in signed], radius)):
        by.setdefault(g, []).append(signed[k])
    return {frozenset(v) for v in by.values() if len(v) > 1}


def test_all_band_widths_radii_and_blocks(spark, monkeypatch):
    r = random.Random(3)
    signed = [int(np.uint64(x).view(np.int64)) for x in near(r, 90, 4)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    monkeypatch.setattr(simhash, "VISITORS", 7)
    for widths, shard, radius in (({3: 58}, 5, 2), ({1: 1}, 1 << 20, 2), ({2: 1}, 9, 3), ({3: 58}, 9, 0)):
        monkeypatch.setattr(simhash, "WIDTHS", widths)
        monkeypatch.setattr(simhash, "SHARD", shard)
        label = {}
        for x in simhash.components(simhash.links(df, radius)).collect():
            label.setdefault(x.label, set()).add(x.node)
        assert {frozenset(v) for v in label.values()} == brute(signed, radius), (widths, shard, radius)


def test_visits_are_bounded(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(r.getrandbits(64) - 2**63,) for _ in range(2000)], "fp long")
    for width, most in ((3, 33), (1, 41)):
        _, visited = simhash.cells([r.getrandbits(16) for _ in range(4)], width, 2)
        sizes = [x.n for x in df.select(simhash.F.size(visited).alias("n")).collect()]
        assert max(sizes) <= most and min(sizes) >= 1
