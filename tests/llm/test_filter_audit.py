"""The filter audit against a plain loop over documents, orders and steps, and against its SQL."""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import duckdb
import pytest
from edge import ODD, documents
from pyspark.sql import functions as F

from terravane.llm import filter_audit
from terravane.llm.queries import ORACLE, QUERIES

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
LABELS = [(4, 1, 0), (4, 0, 1), (5, 1, 1), (8, 1, 0), (12, None, 1), (None, 1, 1), (9, 0, 0), (13, 1, 0), (14, 1, 0)]


def plain(rows, labels):
    """rows: doc_id, text, lang."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    out = Counter()
    parts = {p or "" for _, _, p in rows}
    for d, t, p in rows:
        t, p = t or "", p or ""
        w = t.encode().split()
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t],
        }
        good = any(x == d and q == 1 for x, q, _ in labels) and d is not None
        toxic = any(x == d and y == 1 for x, _, y in labels) and d is not None
        for o in permutations("ABCDE"):
            gone = False
            for k, f in enumerate(o, 1):
                key = (p, "".join(o), k)
                if fails[f]:
                    out[key, "redundant" if gone else "removed"] += 1
                    out[key, "unique_fails"] += sum(fails.values()) == 1
                    if not gone:
                        out[key, "good_lost"] += good
                        out[key, "toxic_lost"] += toxic
                        out[p, f] += 1
                    gone = True
                out[key, "kept"] += not gone
    return {(p, "".join(o), k, *(out[(p, "".join(o), k), c] for c in COLUMNS[3:9]), out[p, f]) for p in parts for o in permutations("ABCDE") for k, f in enumerate(o, 1)}


def rows_of(df):
    rows = [tuple(r) for r in df.select(COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS", 2)
    rows = [(d, t, ["en", "de", "", None, "fr"][k % 5]) for k, (d, t) in enumerate([*ODD, *ODD, (20, "Word " * 300), (21, "one two three " * 3), (22, "A b & c " * 80)])]
    langs = {k: lang for k, (_, _, lang) in enumerate(rows)}
    docs = documents(spark, [(d, t) for d, t, _ in rows])
    # The helper gives one language; rows are dealt theirs by position.
    docs = spark.createDataFrame([{**r.asDict(), "lang": langs[k]} for k, r in enumerate(docs.collect())], docs.schema)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.judge(docs, labels), list("ABCDE"))
    assert rows_of(got) == plain(rows, LABELS)


def test_empty_and_general(spark):
    docs, labels = documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.judge(docs, labels), list("ABCDE")).collect() == []
    docs = documents(spark, [(1, "a"), (2, "bb"), (3, "ccc"), (4, None)])
    size = F.length("text")
    judged = filter_audit.judge(docs, labels, {"long": size > 1, "longer": size > 2}, repeats=None)
    got = filter_audit.audit(judged, ["long", "longer"])
    assert sorted((r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got.collect()) == [
        ("longerlong", 1, 3, 1, 0, 0, 1), ("longerlong", 2, 2, 1, 1, 1, 3), ("longlonger", 1, 2, 2, 0, 1, 3), ("longlonger", 2, 2, 0, 1, 0, 1),
    ]
    with pytest.raises(ValueError):
        filter_audit.audit(judged, list("ABCDEFGH"))


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op11_filter_audit']})").fetchall()
    assert rows_of(QUERIES["op11_filter_audit"](spark, sf)) == set(want)
