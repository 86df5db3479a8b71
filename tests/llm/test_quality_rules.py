from __future__ import annotations

import random
import re
from collections import Counter
from math import prod

import pytest
from edge import ODD, documents
from pyspark.sql import functions as F

from terravane.llm import quality_rules

SF = "/root/testdata/sf0.01"


def plain(text):
    t = text or ""
    w = re.findall("[^\\x20\\x09-\\x0D]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def counted(rows):
    return sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)


def test_counts_of_odd_documents(spark):
    rows = quality_rules.judge(documents(spark, ODD)).collect()
    assert counted(rows) == sorted((str(d), *plain(t)) for d, t in ODD)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_counts_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality_rules.counts(docs).collect()
    assert counted(rows) == sorted((str(d), *plain(t)) for d, t in texts.items())


def test_verdicts_agree_with_labels(spark):
    judged = quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet"))
    joined = judged.filter("not base_failed").join(spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id")
    right = joined.agg(F.avg(((F.col("label") == 1) == F.col("kept")).cast("int")).alias("x")).first().x
    assert right > 0.98


def plain_fit(votes, rounds=200, strength=20):
    """Expectation-maximisation row by row."""
    names = list(votes[0])
    model = first = quality_rules.start()
    for _ in range(rounds):
        size = {c: strength * w for c, w in first.weight.items()}
        bad = {c: {k: strength * p for k, p in x.items()} for c, x in first.bad.items()}
        cast = {c: dict.fromkeys(names, float(strength)) for c in first.bad}
        for v in votes:
            score = {c: w * prod(model.bad[c][k] if v[k] < 0 else 1 - model.bad[c][k] for k in names if v[k]) for c, w in model.weight.items()}
            for c in score:
                share = score[c] / sum(score.values())
                size[c] += share
                for k in names:
                    bad[c][k] += share * (v[k] < 0)
                    cast[c][k] += share * (v[k] != 0)
        p = {c: {k: bad[c][k] / cast[c][k] for k in names} for c in bad}
        for c, x in p.items():
            for k in names:
                x[k] = min(x[k], 0.5) if c == "good" else max(x[k], 0.5) if k in quality_rules.KINDS[c] else x[k]
        model = quality_rules.Model({c: x / sum(size.values()) for c, x in size.items()}, p)
    return model


def test_fit_equals_plain_expectation_maximisation(spark):
    voted = quality_rules.votes(quality_rules.counts(spark.read.parquet(f"{SF}/documents.parquet"))).limit(300).cache()
    names = list(quality_rules.rules())
    got, want = quality_rules.fit(voted, rounds=40), plain_fit([{k: r[f"v_{k}"] for k in names} for r in voted.collect()], rounds=40)
    for c in want.weight:
        assert got.weight[c] == pytest.approx(want.weight[c], rel=1e-6)
        for k in names:
            assert got.bad[c][k] == pytest.approx(want.bad[c][k], rel=1e-6)


def prose(r, n, **odd):
    """n words in sentences; odd: shares of words with a symbol, with capitals only, and without sentence ends."""
    out = []
    for k in range(n):
        w = "".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.choice((2, 3, 5, 6, 7, 8))))
        w += "." if k % 9 == 8 and not odd.get("endless") else ""
        w = w + "##" if r.random() < odd.get("symbols", 0) else w
        w = w.upper() + "!!" if r.random() < odd.get("shout", 0) else w
        out.append(w)
    return " ".join(out)


def test_lone_weak_votes_are_outweighed_and_several_are_not(spark):
    r = random.Random(5)
    texts = [prose(r, 120) for _ in range(300)]
    endless = [prose(r, 120, endless=True) for _ in range(12)]  # one bad vote: no sentence ends
    few = [prose(r, 120, symbols=0.15) for _ in range(8)]  # one or two: symbols, hardly any unclean words
    junk = [prose(r, 120, symbols=0.9, endless=True) for _ in range(25)]
    shouts = [prose(r, 120, shout=0.9) for _ in range(15)]
    every = texts + endless + few + junk + shouts
    kept = {x.doc_id: x for x in quality_rules.judge(documents(spark, list(enumerate(every)))).collect()}
    bad = {d: sum(x[f"v_{k}"] == -1 for k in quality_rules.rules()) for d, x in kept.items()}
    a, b, c = len(texts), len(texts) + len(endless), len(texts) + len(endless) + len(few)
    assert all(kept[d].kept for d in range(a))
    assert all(kept[d].kept and bad[d] == 1 for d in range(a, b))  # all must pass would reject these
    assert all(kept[d].kept for d in range(b, c))
    assert not any(kept[d].kept for d in range(c, len(every))) and all(bad[d] > 1 for d in range(c, len(every)))


def test_keep_good_keeps_columns(spark):
    docs = documents(spark, ODD)
    kept = quality_rules.keep_good(docs)
    assert kept.schema == docs.schema
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids.count("5") == 2 and "None" in ids and "0" not in ids and "13" not in ids


def test_no_python_in_the_plan(spark):
    plan = quality_rules.judge(documents(spark, ODD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert quality_rules.judge(documents(spark, []).limit(0)).collect() == []
    assert quality_rules.keep_good(documents(spark, []).limit(0)).collect() == []


