"""Keyword registers and name overlaps at any size, against nested loops."""

from __future__ import annotations

import random
import re
import time

import pytest
from fixtures import requests, tables
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.functions.expr import has_keyword, overlaps
from terravane.operators import keywords, matching
from terravane.operators.containing import containing, overlapping
from terravane.operators.keywords import Automaton, owners_found
from terravane.streaming import alerts


def stands(text, word):
    return re.search(f"(?<![a-z]){re.escape(word)}(?![a-z])", text) is not None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab é😀", min_size=1, max_size=6), max_size=12, unique=True), st.lists(st.one_of(st.none(), st.text("ab é😀", max_size=40)), max_size=8), st.integers(1, 7))
def test_automaton(words, texts, chunk):
    alone = [len(w) < 3 for w in words]
    before = keywords.CHUNK, keywords.TOGETHER
    keywords.CHUNK, keywords.TOGETHER = chunk, 30
    try:
        text, word = Automaton(words, alone).found(texts)
    finally:
        keywords.CHUNK, keywords.TOGETHER = before
    want = [(i, k) for i, t in enumerate(texts) for k, w in enumerate(words) if t and (stands(t, w) if alone[k] else w in t)]
    assert list(zip(text.tolist(), word.tolist())) == want


def no_nested_loop(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan, plan


def register(n, seed=1):
    r = random.Random(seed)
    made = {"".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(r.randrange(1, 14))).strip() for _ in range(n)}
    return sorted(made - {""})


@pytest.mark.parametrize("mode", ["substring", "boundary"])
def test_100_000_keywords(spark, mode):
    words = register(130_000)
    assert len(words) > 100_000
    r = random.Random(4)
    texts = [" ".join(r.choice(words) for _ in range(6)) + "x" * (k % 3) for k in range(40)] + [None, "", "  "]
    rows = spark.createDataFrame([(k, t, "other") for k, t in enumerate(texts)], "request_id long, said string, owner_name string")
    keys = spark.createDataFrame([("said", w, k // 2) for k, w in enumerate(words)], "field string, keyword string, owner long")
    keys = keys.withColumn("alone", keywords.short_ones(F.col("keyword"), mode))
    began = time.perf_counter()
    found = owners_found(rows, keys)
    got = sorted((x.request_id, x.owner) for x in found.collect())
    took = time.perf_counter() - began
    want = sorted({(i, k // 2) for i, t in enumerate(texts) for k, w in enumerate(words) if t and w in t and (mode == "substring" or len(w) > 3 or stands(t, w))})
    assert got == want and took < 60
    no_nested_loop(found)
    joined = owners_found(rows, keys, most=1000)
    no_nested_loop(joined)
    assert sorted((x.request_id, x.owner) for x in joined.collect()) == want
    least = {}
    for i, o in want:
        least.setdefault(i, o)
    for most in (keywords.MOST, 1000):
        assert {x.request_id: x.owner for x in owners_found(rows, keys, first=True, most=most).collect()} == least


def test_several_fields_and_odd_rows(spark):
    rows = spark.createDataFrame([(1, "by the sea", "sea wall"), (1, "by the sea", "sea wall"), (2, None, "the"), (3, "", None)], "id long, a string, b string")
    keys = spark.createDataFrame([("a", "sea", False, 7), ("b", "sea", True, 7), ("b", "the", True, 5), ("a", "", False, 1), ("a", None, False, 2), ("a", "e", False, None), ("a", "e", False, -3)], "field string, keyword string, alone boolean, owner long")
    got = sorted((r.id, r.owner) for r in owners_found(rows, keys).collect())
    assert got == [(1, -3), (1, -3), (1, 7), (1, 7), (2, 5)]
    assert sorted({(r.id, r.owner) for r in owners_found(rows, keys, most=0).collect()}) == sorted(set(got))
    assert owners_found(rows, keys.limit(0)).collect() == [] and owners_found(rows, keys.limit(0), most=-1).collect() == []
    assert owners_found(rows.limit(0), keys).collect() == []


def test_rules_and_places_are_alike_at_every_size(spark):
    t = tables(spark)
    asked = matching_requests(spark)
    for mode in ("substring", "boundary"):
        few = sorted((r.request_id, r.id) for r in matching.matched_rules(asked, t["rules"], mode).collect())
        many = sorted((r.request_id, r.id) for r in matching.matched_rules(asked, t["rules"], mode, most=3).collect())
        place, plan = F.lower(F.coalesce("location", F.lit(""))), F.lower(F.coalesce("scenario", F.lit("")))
        any_of = lambda keys, x: F.coalesce(F.exists(keys, lambda k: has_keyword(x, F.lower(k), mode)), F.lit(False))
        loop = asked.crossJoin(t["rules"]).filter(any_of("match.location_keywords", place) | any_of("match.scenario_keywords", plan))
        assert few == many == sorted((r.request_id, r.id) for r in loop.collect()) and few
    table = matching.keyword_table(spark, t["regions"])
    few, many = (matching.resolved_places(asked, table, **more) for more in ({}, {"most": 10}))
    no_nested_loop(few)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def matching_requests(spark):
    asked = requests(spark).select("request_id", "location", "scenario")
    more = spark.createDataFrame([(90, None, None), (91, "Wattle, act", "WA campus"), (92, "PERTH wa", "heat"), (93, "", "x")], asked.schema)
    return asked.unionByName(more)


def test_overlaps_against_a_nested_loop(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randrange(0, 9)))
    left = spark.createDataFrame(sorted({(word(), k % 3) for k in range(150)}) + [(None, 1)], "text string, s int")
    right = spark.createDataFrame(sorted({(word(), k % 3) for k in range(150)}) + [("abcabc" * 300, 2)], "text string, s int")
    for on in ([], ["s"]):
        a, b = left.select(*on, "text").distinct(), right.select(*on, "text").distinct()
        got = overlapping(a, b, on)
        no_nested_loop(got)
        x, y = a.alias("x"), b.alias("y")
        loop = x.crossJoin(y).filter(overlaps(F.col("x.text"), F.col("y.text")))
        loop = loop.filter("x.s = y.s") if on else loop
        want = sorted(map(tuple, loop.select(*[f"x.{c}" for c in on], "x.text", "y.text").collect()))
        assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    assert containing(left.select("text").limit(0), right.select(F.col("text").alias("part"))).collect() == []


def test_alerts_over_many_rules(spark):
    events = spark.createDataFrame([(1, "Flood watch"), (2, None), (3, "heat")], "event_id long, event_type string")
    rules = spark.createDataFrame([("a", ["FLOOD", ""]), ("b", ["eat", "watch"]), ("c", None), ("d", ["zzz"])] + [(f"r{k}", [f"key{k}"]) for k in range(25_000)], "id string, keywords array<string>")
    got = alerts.rule_alerts(events, rules)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (3, "b")]
    with pytest.raises(ValueError):
        alerts.rule_alerts(events, rules, most=100)
