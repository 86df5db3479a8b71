"""Filter interaction audit: what each filter removes in every order of filters, by first-failure lookup.

A document is told by the set of filters that it fails, one bit for each. In an order of the filters the first of
them that the document fails removes it, so a table of 2**k sets by k! orders, made once, names the step. Tasks look
their documents up in it batch by batch (mapInArrow), add up removals by part, order, step and label with
np.bincount, and hand on one array a part; the partial arrays are summed. Everything else follows from the removals:
a filter's failures are what it removes when it comes first, its unique failures what it removes when it comes last.

Failing filters are Columns of the documents. The one that looks beyond a document, "identical to the text of a
smaller doc_id", is found by joining each row with the least doc_id of its text, on both, so that a text
of very many copies is spread by their ids.

Edge cases: a null text counts as empty, a null lang is the part ""; filters that yield null aren't failed; rows
with a null doc_id have no labels, repeat no text and are repeated by none; rows that repeat a doc_id are judged each, and of
equal texts none with the smallest doc_id is a repetition; a doc_id with several labels has all of them; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, words

#: Filters at most: the table has 2**k rows of k! orders.
MOST = 7
#: Parts of which a task holds sums at once.
PARTS = 512


def first_failures(k: int) -> np.ndarray:
    """The step (from 0; k: none) that removes a document, by its set of failed filters and by order."""
    orders = np.array(list(permutations(range(k))), np.int64).reshape(-1, k)
    fails = (np.arange(1 << k)[:, None, None] >> orders[None]) & 1  # set, order, step
    return np.where(fails.any(axis=2), fails.argmax(axis=2), k).astype(np.int16)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D: few words, repeated words, capitals, symbols."""
    w = words(text)
    n, capitals = F.size(w), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(w)) < 50 * n,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def repeated(rows: DataFrame, key: str, doc: str) -> DataFrame:
    """rows (read twice) with a column again: whether another row with this key has a smaller doc."""
    least = rows.filter(F.col(doc).isNotNull()).groupBy(key).agg(F.min(doc).alias("__least"))
    first = least.select(F.col(key).alias("__key"), "__least", F.lit(True).alias("__first"))
    joined = rows.join(first, (F.col(key) == F.col("__key")) & (F.col(doc) == F.col("__least")), "left")
    return joined.withColumn("again", F.col(doc).isNotNull() & F.col("__first").isNull()).drop("__key", "__least", "__first")


def removals(judged: DataFrame, k: int) -> DataFrame:
    """part, order, step (both from 0), total, removed, good, toxic: judged has part, fails (bits), good, toxic (0/1), n (rows like it)."""
    table = first_failures(k)
    orders, steps = table.shape[1], k + 1
    size, most = orders * steps, PARTS

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            arrays = [pa.array([x[i].astype(np.int64).tolist() for x in held.values()], pa.list_(pa.int64())) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *arrays], ["part", "removed", "good", "toxic"])

        for b in batches:
            parts = b.column(0).dictionary_encode()
            at, names = parts.indices.to_numpy(zero_copy_only=False), parts.dictionary.to_pylist()
            fails, good, toxic, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            for p, name in enumerate(names):
                mine = np.flatnonzero(at == p)
                # Rows that are alike are counted first, so that the look-up costs 2**k rows a batch at most.
                kinds, of = np.unique(fails[mine] * 4 + good[mine] * 2 + toxic[mine], return_inverse=True)
                times = np.bincount(of, n[mine], len(kinds))
                cell = (table[kinds // 4] + np.arange(orders) * steps).ravel()
                sums = held.setdefault(name, np.zeros((3, size)))
                for i, keep in enumerate((np.ones(len(kinds)), kinds // 2 % 2, kinds % 2)):
                    sums[i] += np.bincount(cell, np.repeat(times * keep, orders), size)
                if len(held) >= most:
                    yield out()
                    held.clear()
        if held:
            yield out()

    sums = judged.select("part", "fails", "good", "toxic", "n").mapInArrow(look_up, "part string, removed array<long>, good array<long>, toxic array<long>")
    cells = sums.select("part", F.posexplode(F.arrays_zip("removed", "good", "toxic")).alias("cell", "x"))
    summed = cells.groupBy("part", "cell").agg(*(F.sum(f"x.{c}").alias(c) for c in ("removed", "good", "toxic")))
    return summed.select("part", F.floor(F.col("cell") / steps).cast("int").alias("order"), (F.col("cell") % steps).cast("int").alias("step"), "removed", "good", "toxic")


def audit(judged: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order and step, zeros included, of documents with part, fails, good, toxic and n (see removals).

    kept after the step; removed in it; redundant: fail its filter but are gone already; unique_fails: fail its filter
    alone; good_lost and toxic_lost: removed in it, with those labels; shapley: its filter's removals summed over all orders.
    """
    k = len(names)
    if not 0 < k <= MOST:
        raise ValueError(f"1 to {MOST} filters")
    orders = list(permutations(range(k)))
    spelled = F.array(*(F.lit("".join(names[i] for i in o)) for o in orders))
    letters = F.array(*(F.lit(names[i]) for o in orders for i in o))
    cells = removals(judged, k).withColumn("name", F.when(F.col("step") < k, F.get(letters, F.col("order") * k + F.col("step"))))
    # A part has (k + 1) k! cells, however many documents: its windows are small.
    order, name = Window.partitionBy("part", "order"), Window.partitionBy("part", "name")
    left = order.orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    over = lambda c, at: (F.sum(F.when(F.col("step") == at, F.col(c))).over(name) / factorial(k - 1)).cast("long")
    rows = cells.select(
        "part", F.get(spelled, F.col("order")).alias("filter_order"), (F.col("step") + 1).alias("step"), F.sum("removed").over(left).alias("kept"), "removed",
        (over("removed", 0) - F.col("removed")).alias("redundant"), over("removed", k - 1).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(name).alias("shapley"),
    )
    return rows.filter(F.col("step") <= k)


def judge(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, repeats: str | None = "E") -> DataFrame:
    """part, fails, good, toxic, n of documents (doc_id, text, lang): filters in their order, then repeats of a text under that name."""
    text = F.coalesce("text", F.lit(""))
    conditions = list((text_filters(F.col("__text")) if filters is None else filters).values())
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))
    rows = docs.withColumn("__text", text).select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("lang", F.lit("")).alias("part"), bits.alias("fails"), F.unhex(F.sha2("__text", 256)).alias("key"))
    # Repeated rows become one with their number; few bytes a document are left, so they are kept rather than counted again.
    rows = stored(rows.groupBy("doc", "part", "fails", "key").agg(F.count(F.lit(1)).alias("n")), "audited")
    if repeats is not None:
        rows = repeated(rows, "key", "doc").withColumn("fails", F.col("fails") + F.when(F.col("again"), 1 << len(conditions)).otherwise(0))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    # Rows without id match nothing: dealt out by their texts, they don't meet in one task.
    known = known.withColumn("spread", F.lit(0).cast("long"))
    rows = rows.withColumn("by", F.when(F.col("doc").isNull(), F.xxhash64("key")).otherwise(0))
    joined = rows.join(known, (F.col("doc") == F.col("of")) & (F.col("by") == F.col("spread")), "left")
    return joined.select("part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
