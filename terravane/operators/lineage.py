"""Report versions, review events and probe summaries, as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane.functions.expr import slug


def versions(events: DataFrame, key: str, order: str, new: Column | None = None) -> DataFrame:
    """events with version, from 1, and parent_order, the order of the version before.

    new marks events that start over with version 1 and no parent.
    """
    w = Window.partitionBy(key).orderBy(order)
    run = events.withColumn("__run", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w) if new is not None else F.lit(0))
    own = Window.partitionBy(key, "__run").orderBy(order)
    return run.withColumns({"version": F.row_number().over(own), "parent_order": F.lag(order).over(own)}).drop("__run")


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def latest_text(messages: DataFrame, thread: str, welcome: Column) -> DataFrame:
    """thread, text: the last report of an assistant that is no welcome text."""
    said = messages.filter((F.col("role") == "assistant") & ~welcome)
    return said.groupBy(thread).agg(F.max_by("content", "turn").alias("text"))


def review_state(audits: DataFrame, reviews: DataFrame) -> DataFrame:
    """Audits with their latest review and the history of all, in order of updated_at; nothing is rewritten."""
    fields = [c for c in reviews.columns if c != "report_id"]
    history = reviews.groupBy("report_id").agg(
        F.max_by(F.struct(*fields), "updated_at").alias("human_review"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("updated_at").alias("o"), F.struct(*fields).alias("r")))), lambda x: x["r"]).alias("human_review_history"),
    )
    joined = audits.join(history, "report_id", "left")
    return joined.withColumn("report_status", F.coalesce("human_review.approval_status", "report_status"))


def audit_name(at: Column, location: Column, token: Column) -> Column:
    """audit_<time>_<place>_<token>: unique per report; time and token are the caller's."""
    return F.concat_ws("_", F.lit("audit"), F.date_format(at, "yyyyMMdd_HHmmss_SSSSSS"), slug(location), token)


def checklist_complete(values: Column) -> Column:
    """All ticked, and at least one."""
    return (F.coalesce(F.size(values), F.lit(0)) > 0) & F.coalesce(F.forall(values, lambda v: v), F.lit(False))


def probe_measures() -> dict[str, Column]:
    """total, reachable and failed, as aggregates: of a grouping, or of a write that happens anyway (sinks.observed)."""
    return {"total": F.count(F.lit(1)), "reachable": F.count_if(F.col("status") == "Reachable"), "failed": F.count_if(F.col("status") == "Check failed")}


def probe_summary(probes: DataFrame, *by: str) -> DataFrame:
    """total, reachable, failed and the rest as warnings."""
    grouped = probes.groupBy(*by).agg(*(c.alias(k) for k, c in probe_measures().items()))
    return grouped.withColumn("warnings", F.col("total") - F.col("reachable") - F.col("failed"))
