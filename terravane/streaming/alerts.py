"""Extensions over event streams: summaries by window, keyword alerts and latest state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions.expr import any_contains
from terravane.operators.keywords import MOST, owners_found


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Events with ts as a timestamp, and a watermark if they are a stream."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late) if events.isStreaming else stamped


def window_summary(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and values by window and type; works on batches and streams, late rows up to the watermark count."""
    timed = _timed(events, late)
    grouped = timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "total")


def keyword_alerts(events: DataFrame, keywords: Sequence[str], column: str = "event_type") -> DataFrame:
    """Events whose text holds any of the keywords; stateless, so alike for batches and streams."""
    return events.filter(any_contains(F.lower(column), keywords))


def rule_alerts(events: DataFrame, rules: DataFrame, column: str = "event_type", most: int = MOST) -> DataFrame:
    """(event_id, rule_id) by keyword lists of rules (id, keywords): one pass over each event for all rules.

    Every micro-batch carries the rules' keywords, so these are held in one automaton; registers of more letters are
    refused, not cut. Tables of more rules are matched in batches, by matching.matched_rules().
    """
    keys = rules.select("id", F.explode(F.transform("keywords", F.lower)).alias("keyword")).filter("keyword <> ''")
    if (keys.agg(F.sum(F.length("keyword"))).first()[0] or 0) > most:
        raise ValueError(f"keywords of more than {most} letters; match them in batches")
    ids = keys.select("id").distinct().collect()  # within the checked size
    known = events.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(ids)], f"owner long, id {keys.schema['id'].dataType.simpleString()}")
    said = events.select("event_id", F.lower(F.col(column)).alias("said"))
    owned = keys.join(known, "id").select(F.lit("said").alias("field"), "keyword", F.lit(False).alias("alone"), "owner")
    return owners_found(said, owned, most=most).join(F.broadcast(known), "owner").select("event_id", F.col("id").alias("rule_id"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end and number of events of sessions that end after a gap."""
    timed = _timed(events, late)
    grouped = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")
