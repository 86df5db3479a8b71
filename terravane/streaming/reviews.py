"""Review state of reports as a stream: the latest audit of each report with its latest review and the history of all.

What arrives late is merged by its own order, not by its arrival, so that any order of arrival ends in what
lineage.latest() and lineage.review_state() make of the whole tables. Each report's audit is one value in the state, and its
reviews are a list that is only added to.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Keeps what to_json() would cut off.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
OUT = "report_id string, audit string, history array<string>"


class Reviews(StatefulProcessor):
    """One report: its audit of the highest order (of equal ones the greatest text), and all its reviews."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.audit = handle.getValueState("audit", "at long, body string")
        self.history = handle.getListState("history", "body string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = self.audit.get() if self.audit.exists() else None
        new = None
        for part in rows:
            for at, body in part.loc[part["audit"], ["at", "body"]].itertuples(index=False):
                if best is None or (int(at), body) > (int(best[0]), best[1]):
                    best = new = (int(at), body)
            added = [(body,) for body in part.loc[~part["audit"], "body"]]
            if added:
                self.history.appendList(added)
        if new is not None:
            self.audit.update(new)
        if best is not None:  # reviews wait for their audit
            yield pd.DataFrame({"report_id": [key[0]], "audit": [best[1]], "history": [[x[0] for x in self.history.get()]]})


def prepare(spark: SparkSession) -> None:
    """Such state needs a store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _events(rows: DataFrame, audit: bool, at: Column) -> DataFrame:
    return rows.filter("report_id is not null").select("report_id", F.lit(audit).alias("audit"), F.coalesce(at, F.lit(-(1 << 63))).alias("at"), F.to_json(F.struct("*"), EXACT).alias("body"))


def review_states(audits: DataFrame, reviews: DataFrame, version: str = "report_version") -> DataFrame:
    """The columns of audits, human_review and human_review_history of every report that a batch has touched (output mode update).

    audits (report_id, version, report_status, ...) and reviews (report_id, updated_at, approval_status, ...) are streams of one session;
    version is a whole number. The last row of a report that was put out is its state; see upserted().
    """
    events = _events(audits, True, F.col(version).cast("long")).unionByName(_events(reviews, False, F.lit(0).cast("long")))
    states = events.groupBy("report_id").transformWithStateInPandas(Reviews(), outputStructType=OUT, outputMode="Update", timeMode="None")
    fields = StructType([f for f in reviews.schema if f.name != "report_id"])
    order = F.transform(F.array_sort(F.transform("history", lambda h: _ordered(h, fields))), lambda x: x["r"])
    told = states.select(F.from_json("audit", audits.schema, EXACT).alias("a"), F.when(F.size("history") > 0, order).alias("human_review_history"))
    last = F.try_element_at("human_review_history", F.lit(-1))
    told = told.withColumn("human_review", F.when(last["updated_at"].isNotNull(), last))  # one without time is history only
    status = F.coalesce("human_review.approval_status", "a.report_status").alias("report_status")
    return told.select(*(status if c == "report_status" else F.col(f"a.{c}") for c in audits.columns), "human_review", "human_review_history")


def _ordered(body: Column, fields: StructType) -> Column:
    review = F.from_json(body, fields, EXACT)
    return F.struct(review["updated_at"].alias("o"), review.alias("r"))


def upserted(old: DataFrame, batch: DataFrame) -> DataFrame:
    """A table of states with those of a micro-batch in place of earlier ones."""
    return old.join(batch, "report_id", "left_anti").unionByName(batch)
