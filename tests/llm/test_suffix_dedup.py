from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from edge import ODD, PROSE, documents

from terravane.llm import suffix_dedup


def brute(texts, threshold=100):
    """doc_id to (bytes, removed, spans, sha) for rows with distinct (doc_id, text)."""
    place = {}
    rows = sorted({(d, t or "") for d, t in texts}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - threshold + 1):
            here = (d is not None, d or 0, i)
            place[b[i : i + threshold]] = min(place.get(b[i : i + threshold], here), here)
    out = {}
    for d, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - threshold + 1):
            if place[b[i : i + threshold]] < (d is not None, d or 0, i):
                gone[i : i + threshold] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def compare(spark, texts, threshold=100):
    found = brute(texts, threshold)
    want = sorted((str(d), *found[d, t or ""]) for d, t in texts)
    rows = suffix_dedup.digest(documents(spark, texts), threshold).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == want
    assert all(sum(x.end - x.start for x in r.spans) == r.n_removed for r in rows)


def test_odd_documents(spark):
    compare(spark, ODD)


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randint(30, 300))) for _ in range(12)]
    texts = [(k, "".join(r.choice(passages) if r.random() < 0.7 else "".join(r.choice("abc ") for _ in range(r.randint(1, 90))) for _ in range(r.randint(0, 6)))) for k in range(60)]
    compare(spark, texts)


def test_many_rows_without_id(spark):
    r = random.Random(7)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = [make(110) for _ in range(40)]
    texts = [(None, make(r.randint(0, 60)) + (r.choice(shared) if k % 3 else make(110)) + make(r.randint(0, 60))) for k in range(1500)]
    compare(spark, texts)
    placed, _, _ = suffix_dedup._found(documents(spark, texts), 100)
    assert placed.select("__tv_bucket").distinct().count() > 30


def test_rows_that_share_an_id_and_a_beginning(spark):
    r = random.Random(2)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    start = make(300)
    for first, second in ((1, 5), (1, None), (None, None), (9, 5)):
        compare(spark, [(first, "x" + start + "y"), (second, start + "a"), (second, start + "b")])
    # Repeated ids and shared beginnings, middles and ends.
    texts = []
    parts = [make(r.randint(60, 260)) for _ in range(8)]
    for k in range(220):
        texts.append((r.choice([None, k, k % 7, k % 20]), "".join(r.choice(parts) for _ in range(r.randint(1, 3))) + make(r.randint(0, 3))))
    compare(spark, texts)


def test_line_that_stands_once_in_each_piece(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "NOTED", 8)
    pieces = [np.frombuffer(t.encode(), np.uint8) for _, t in line_in_many_texts(600)]
    none, times = np.zeros(0, np.int64), Counter()
    for buf in pieces:
        assert not len(suffix_dedup.frequent(buf)[0])
        for h, n in zip(*(x.tolist() for x in suffix_dedup.noted(buf, none))):
            times[h] += n
    each = Counter(h for buf in pieces for h in set(suffix_dedup.string_hashes(buf)[1].tolist()))
    line = [h for h, n in each.items() if n == 600 and h < 1 << 61]
    assert len(line) > 4 and all(300 < times[h] < 900 for h in line)
    assert max(times[h] for h in times if each[h] == 1) == 8


def line_in_many_texts(n):
    r = random.Random(11)
    make = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    line, passage = make(70), make(240)
    return [(k, make(r.randint(60, 150)) + line + make(r.randint(60, 150)) + (passage[r.randint(0, 90) :] if k % 5 == 0 else "") + make(20)) for k in range(n)]


def test_common_lines(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COMMON", 30)
    compare(spark, line_in_many_texts(150))


def test_common_strings_come_last():
    texts = [t.encode() for _, t in line_in_many_texts(300)]
    h, n = suffix_dedup.frequent(np.frombuffer(b"".join(texts), np.uint8))
    common = np.sort(h[n >= 30].astype(np.uint64))
    assert len(common) >= 70 - suffix_dedup.SEED + 1
    largest = []
    for known in (common[:0], common):
        r = np.concatenate(list(suffix_dedup.text_runs(list(range(300)), texts, 100, known)))
        _, each = np.unique(np.unique(r[["v", "c"]])["v"], return_counts=True)  # digests of a digit
        largest.append(each.max())
    assert largest[0] > 250 and largest[1] < 70, largest


def test_periodic_texts(spark):
    compare(spark, [(1, "abc" * 100), (2, "x" * 400), (3, "x" * 150 + "y" + "x" * 99), (4, ("Éan " * 90)), (5, "q" * 99), (6, "cab" * 80)])


def test_other_threshold(spark):
    compare(spark, [(1, PROSE), (2, "z" + PROSE[50:200]), (3, PROSE[20:75])], threshold=50)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    r = random.Random(9)
    parts = ["".join(r.choice("abcdef ") for _ in range(700)) for _ in range(3)]
    ids, texts = [1, 2], ["".join(parts).encode(), (parts[1] + parts[0]).encode()]
    n = [sum(int(x["n"] % suffix_dedup.TIED) for x in part) for part in suffix_dedup.text_runs(ids, texts, 100)]
    assert sum(n) == sum(len(t) - 99 for t in texts)  # every suffix is in one run


def test_strip_keeps_columns_and_characters(spark):
    docs = documents(spark, [(1, "é" * 80), (2, "a" + "é" * 80 + "b"), (3, "é" * 80), (4, None), (5, "")])
    out = suffix_dedup.strip(docs)
    assert out.schema == docs.schema
    # Of document 1 the first period stays, document 2 loses what it shares, 3 all and goes; null and empty texts stay.
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é", 2: "ab", 4: None, 5: ""}


def test_empty_table(spark):
    assert suffix_dedup.digest(documents(spark, []).limit(0)).collect() == []
    assert suffix_dedup.strip(documents(spark, []).limit(0)).collect() == []
