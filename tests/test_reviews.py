"""Review states from streams in any order of arrival, against the batch operators."""

from __future__ import annotations

import datetime
import random

import pytest

from terravane.operators import lineage
from terravane.streaming import reviews as streams

AUDIT = "report_id string, report_version long, report_status string, created_at timestamp, note string"
REVIEW = "report_id string, updated_at timestamp, approval_status string, reviewer struct<name:string,role:string>, checklist array<boolean>"


def made(seed):
    r = random.Random(seed)
    at = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k, microseconds=k * 7 % 1000)
    audits = [(f"r{k % 6}", k // 6, ["Draft", None][k % 2], at(k), [None, "né\n"][k % 2]) for k in range(24)] + [(None, 1, "x", at(1), "x")]
    reviews = [(f"r{r.randrange(9)}", at(10 * k), r.choice(["Draft", "Approved by organisation", None]), (r.choice(["a", None]), "b"), r.choice([None, [], [True, False]])) for k in range(40)]
    reviews = [x for x in reviews if x[0] != "r2"] + [("r1", None, "Odd", None, None), ("r2", None, "Odd", None, None)]
    return audits, reviews


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    streams.prepare(spark)
    audits, reviews = made(seed)
    whole_a, whole_r = spark.createDataFrame(audits, AUDIT), spark.createDataFrame(reviews, REVIEW)
    want = lineage.review_state(lineage.latest(whole_a.filter("report_id is not null"), "report_id", "report_version"), whole_r)
    r = random.Random(seed)
    arrived = [("a", x) for x in audits] + [("r", x) for x in reviews]
    r.shuffle(arrived)
    for name, schema in (("a", AUDIT), ("r", REVIEW)):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    source = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
    states = streams.review_states(source("a", AUDIT), source("r", REVIEW))
    known = {}

    def keep(batch, number):
        known.update({x.report_id: x for x in batch.collect()})

    start = lambda: states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
    for k in range(3):  # each time a new run, which goes on from the last one's state
        for name, schema in (("a", AUDIT), ("r", REVIEW)):
            some = [x for n, x in arrived[k * 22 : k * 22 + 22] if n == name]
            if some:
                spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        query = start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    columns = want.columns
    got = sorted(tuple(repr(x[c]) for c in columns) for x in known.values())
    assert got == sorted(tuple(repr(x[c]) for c in columns) for x in want.collect())
    assert len(got) == 6 and any(len(x.human_review_history or []) > 3 for x in known.values())


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "report_id string, v int")
    assert sorted(map(tuple, streams.upserted(old, spark.createDataFrame([("b", 2), ("c", 2)], old.schema)).collect())) == [("a", 1), ("b", 2), ("c", 2)]
