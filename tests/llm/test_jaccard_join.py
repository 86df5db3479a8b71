"""The exact Jaccard join against comparing every two sets of shingles."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from edge import ODD, documents

from terravane.llm import jaccard_join as jj
from terravane.llm.queries import QUERIES


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain(rows, percent=80):
    """(doc_id, n_shingles, component_id) of (doc_id, text)."""
    each = [shingle_set(t) for _, t in rows]
    known = sorted(set(each) - {frozenset()}, key=len)
    root = {s: s for s in known}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if percent * len(b) > 100 * len(a):
                break
            if find(a) is not find(b) and 100 * len(a & b) >= percent * len(a | b):
                root[find(b)] = find(a)
    least = {}
    for s, (d, _) in zip(each, rows):
        if s and d is not None:
            least[find(s)] = min(least.get(find(s), d), d)
    return Counter((d, len(s), least.get(find(s)) if s else d) for s, (d, _) in zip(each, rows))


def rows_of(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def family(r, n, size, edits, first=0):
    """Texts around one, and some around those: chains whose ends aren't similar."""
    out = [[f"w{r.randrange(10**6)}" for _ in range(size)]]
    while len(out) < n:
        v = list(r.choice(out))
        for _ in range(r.randrange(edits + 1)):
            k = r.randrange(len(v))
            v[k : k + r.randrange(2)] = [f"x{r.randrange(10**6)}"] * r.randrange(2)
        out.append(v)
    return [(first + k, " ".join(v)) for k, v in enumerate(out)]


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_no_similar_pair_goes_without_a_shared_hash(percent):
    r = random.Random(percent)
    none = np.zeros(0, np.uint64)
    met = 0
    for size in (1, 2, 4, 5, 6, 9, 14, 30, 61, 100, 250, 900):
        for _ in range(60):
            a = {r.getrandbits(64) for _ in range(size)}
            b = set(a)
            for _ in range(r.randrange(2 * size * (100 - percent) // (100 + percent) + 2)):
                b = b - {r.choice(sorted(b))} if b and r.random() < 0.5 else b | {r.getrandbits(64)}
            if not b or 100 * len(a & b) < percent * len(a | b) or a == b:
                continue
            met += 1
            x, y = (np.array(sorted(s), np.uint64) for s in sorted((a, b), key=len))
            # Whatever the asking set takes for common.
            hashes, _ = jj.rows_of(y, percent, none, none.astype(np.int64))
            common = np.sort(r.sample(hashes.tolist(), len(hashes) // 3)).astype(np.uint64)
            (k, _), (q, asks) = jj.rows_of(x, percent, common, np.full(len(common), 99)), jj.rows_of(y, percent, common, np.full(len(common), 99))
            assert np.isin(q[asks], k).any()
    assert met > 100


def test_allotted():
    r = np.random.default_rng(1)
    for _ in range(300):
        size, cost = r.integers(0, 12, 20), r.choice([1, 5, 1000], 20)
        need = int(r.integers(1, 21))
        give = jj.allotted(size, cost, need, 6)
        assert give.sum() == need and (size[give == 2] >= 6).all()
        assert (give == 2).sum() <= (give == 0).sum()


def test_words(monkeypatch):
    text = " ".join(f"Wort{k % 700}é" for k in range(3000)) + "  \x0b ende"
    whole = jj.word_hashes(text)
    assert len(whole) == 3001 and len(np.unique(whole)) == 701
    monkeypatch.setattr(jj, "PIECE", 50)
    assert (jj.word_hashes(text) == whole).all()
    assert (jj.word_hashes(text.lower()) == whole).all()
    assert len(jj.shingles("a b c d")) == len(jj.shingles("a b c d e")) == 1 and not len(jj.shingles(" \n"))
    assert jj.shingles("a b c d") != jj.shingles("a b c d e")


def test_bitmaps_never_tell_off_a_similar_pair():
    r = random.Random(6)
    held, sets = [], []
    for k in range(40):
        s = {r.getrandbits(64) for _ in range(r.choice([1, 3, 40, 55, 300]))} if k % 4 == 0 else set(sets[-1])
        for _ in range(r.randrange(0, 1 + len(s) // 6)):
            s = s - {r.choice(sorted(s))} | {r.getrandbits(64)}
        sets.append(s)
        held.append(jj.bitmap(np.array(sorted(s), np.uint64)))
    every = lambda x: np.full(40, x)
    size = np.array([len(s) for s in sets])
    for blocks in (every(0), np.arange(40) % 2):
        found = {tuple(sorted(p)) for p in jj.tile_pairs(np.arange(40), every(True), blocks, size, held, 80, False)}
        alike = {(i, j) for j in range(40) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and (blocks[i] != blocks[j] or not blocks.any())}
        assert alike and alike <= found
        near = {tuple(sorted(p)) for p in jj.tile_pairs(np.arange(40), every(True), blocks, size, held, 80, True)}
        assert near <= found and {x for p in near for x in p} == {x for p in found for x in p} and len(near) <= 40
    assert not jj.tile_pairs(every(1), every(True), every(0), size, held, 80, False) and not jj.tile_pairs(np.arange(40), every(False), every(0), size, held, 80, False)


def peak(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("least", [1, 2, 6])
def test_counting_holds_little_beside_the_hashes(least):
    r = np.random.default_rng(least)
    for n in (0, 1, 3, 1 << 20):
        held = [r.integers(0, max(1, n // 3), n - n // 2, np.uint64), r.integers(0, max(1, n // 3), n // 2, np.uint64)]
        u, times = np.unique(np.concatenate(held), return_counts=True)
        want = u[times >= least].tolist(), times[times >= least].tolist()
        (found, often), most = peak(lambda held=held: jj.counted(held, least))
        assert (found.tolist(), often.tolist()) == want and not held
        assert least < 6 or most < 100_000 + 2 * 8 * n  # np.unique with counts took three times the hashes


def test_hashes_travel_in_small_batches():
    r, n, count = np.random.default_rng(1), 1 << 20, 600
    row, more = np.zeros(n, jj.ROW), np.zeros(n // 8, jj.OFTEN)
    row["k"], row["node"], more["node"] = r.integers(0, 1 << 32, n), r.integers(-9, 9, n), r.integers(-(1 << 40), 1 << 40, len(more))
    place = r.integers(0, count, n).astype(np.int32)
    lists = [row[: n // 2], row[n // 2 :]], [place], [more]
    got = {False: {}, True: {}}

    def run():
        for b in jj.packed(*lists, count):
            assert b.nbytes < jj.SENT + 100_000 and not lists[0]
            for k, rare, often in zip(*b.to_pydict().values()):
                assert (rare is None) != (often is None) and k not in got[rare is None]
                got[rare is None][k] = (jj.unpack(often, jj.OFTEN) if rare is None else jj.unpack(rare, jj.ROW)) if k < 20 else None

    _, most = peak(run)
    assert most < 36_000_000  # one batch of all took 46 MB
    assert len(got[False]) == len(got[True]) == count
    for k in range(20):
        assert (got[False][k] == row[place == k]).all() and (got[True][k] == more[np.mod(more["node"], count) == k]).all()


def test_roots_follow_centres_of_centres(spark):
    star = [(1, k) for k in range(10, 40)]
    chain = [(100, 101), (101, 102), (102, 103), (103, 104), (104, 105)]
    found = {r.node: r.label for r in jj.roots(spark.createDataFrame(star + chain, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(10, 40)} | {101: 100, 102: 100, 103: 100, 104: 100, 105: 101}
    assert jj.roots(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_rows_and_small_limits(spark, monkeypatch):
    r = random.Random(3)
    rows = list(ODD)
    rows += family(r, 40, 90, 6, 100) + family(r, 30, 12, 1, 200) + family(r, 12, 400, 40, 300) + family(r, 30, 6, 1, 400)
    shared = " ".join(f"licence{k}" for k in range(30))
    rows += [(500 + k, shared + " " + " ".join(f"u{k}v{j}" for j in range(20 + k % 9))) for k in range(60)]
    rows += [(None if k % 4 == 0 else 100 + k, t) for k, (_, t) in enumerate(family(r, 20, 60, 4))] + rows[50:60]
    want = plain(rows)
    docs = documents(spark, rows).repartition(3)
    assert rows_of(jj.classes(docs)) == want
    for name, value in (("LOCAL", 1), ("COMMON", 8), ("HELD", 3000), ("DEAR", 3), ("BLOCK", 3), ("TILE", 4), ("BUCKET", 500), ("LEAST_BUCKETS", 2), ("SHINGLES", 2000)):
        monkeypatch.setattr(jj, name, value)
    assert rows_of(jj.classes(docs)) == want
    empty = documents(spark, [])
    assert jj.classes(empty).collect() == []
    assert rows_of(jj.classes(documents(spark, [(1, None), (2, "")]))) == Counter({(1, 0, 1): 1, (2, 0, 2): 1})


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op13_jaccard_join"](spark, sf)) == plain(docs)
