"""Validation of requests and review records: the first error of each row, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane import fixed
from terravane.functions.expr import blank_to, first_error, strip


def blank(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit(""))) == ""


def missing_reviewer() -> Column:
    return F.array_compact(F.array(*(F.when(blank(F.col(k)), label) for k, label in fixed.REVIEWER_FIELDS)))


def _named(start: str) -> Column:
    return F.concat(F.lit(start), F.array_join(missing_reviewer(), ", "), F.lit("."))


def request_error() -> Column:
    """For columns location, audience, concerns, report_status and the reviewer's."""
    reviewed = blank_to(F.col("report_status"), fixed.DRAFT_STATUS).isin(fixed.REVIEWED_STATUSES)
    return first_error(
        (blank(F.col("location")) | blank(F.col("audience")), fixed.ERROR_PLACE),
        (F.coalesce(F.size("concerns"), F.lit(0)) <= 0, fixed.ERROR_CONCERNS),
        (reviewed & (F.size(missing_reviewer()) > 0), _named(fixed.ERROR_REPORT_REVIEW)),
    )


def review_error() -> Column:
    """For columns approval_status, review_checklist_complete and the reviewer's."""
    status = blank_to(F.col("approval_status"), fixed.DRAFT_STATUS)
    return first_error(
        (status.isin(fixed.REVIEWED_STATUSES) & (F.size(missing_reviewer()) > 0), _named(fixed.ERROR_REVIEW)),
        ((status == fixed.APPROVED_STATUS) & ~F.coalesce("review_checklist_complete", F.lit(False)), fixed.ERROR_CHECKLIST),
    )


def geography_error(inferred: Column, selected: Column) -> Column:
    """The form's state against the map's; an unresolved or unselected one contradicts nothing."""
    known = ~F.coalesce(inferred, F.lit("")).isin("", fixed.DEFAULT_STATE) & (F.coalesce(selected, F.lit("")) != "")
    text = F.concat(
        F.lit("The form location resolves to "), inferred, F.lit(", but the active map area is in "), selected,
        F.lit(". Clear the active map area or apply a matching geography before generating."),
    )
    return F.when(known & (inferred != selected), text)
