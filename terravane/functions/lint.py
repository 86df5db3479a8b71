"""The eleven structural checks of a report text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane import fixed
from terravane.functions.expr import all_contained, any_contains, missing_terms, terms_found


class Check(NamedTuple):
    name: str
    passes: Column
    otherwise: str
    good: str
    bad: Column


def checks(text: Column) -> list[Check]:
    """The checks of a text column, in order."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    missing = missing_terms(low, fixed.REQUIRED_SECTIONS)
    unsafe = any_contains(low, fixed.PLACE_TERMS) & any_contains(low, fixed.CONFIRMATION_TERMS)
    # Names, statuses and messages of the checks.
    return [
        Check("Required sections", F.size(missing) == 0, "warning", "The report covers the main required sections.", F.concat(F.lit("Potentially missing: "), F.array_join(missing, ", "))),
        Check("Official sources", terms_found(low, fixed.OFFICIAL_SOURCE_TERMS) >= 4, "warning", "The report includes multiple official information sources.", F.lit("Add the state fire service, local council, Bureau of Meteorology and 000 where relevant.")),
        Check("Safety disclaimer", all_contained(low, fixed.DISCLAIMER_TERMS), "fail", "The report includes a safety disclaimer and official verification reminder.", F.lit("The report should clearly state that live warnings and evacuation orders must come from official sources.")),
        Check("Emergency number 000", F.contains(t, F.lit("000")), "fail", "The report includes 000.", F.lit("The report does not mention 000.")),
        Check("Action plan", all_contained(low, ["action plan", "day 1"]), "warning", "The report includes a day-based action plan.", F.lit("The report should include a Day 1 style action plan.")),
        Check("Checklist", F.contains(low, F.lit("checklist")) & (F.contains(t, F.lit("- [ ]")) | F.contains(low, F.lit("- [x]"))), "warning", "The report includes a checkable checklist.", F.lit("Use Markdown checkboxes for the checklist.")),
        Check("Roles and responsibilities", terms_found(low, fixed.ROLE_TERMS) >= 4, "warning", "The report covers key role responsibilities.", F.lit("Add management, staff/teachers, students, wardens, first aiders and communications roles.")),
        Check("Assembly point wording", ~unsafe, "fail", "No obvious unsafe confirmation of candidate assembly points was detected.", F.lit("Candidate assembly points should not be described as confirmed safe without local and official approval.")),
        Check("Evidence tables", all_contained(low, fixed.EVIDENCE_TABLE_TERMS), "warning", "The report includes deterministic evidence tables for review.", F.lit("Add selected geography, community indicator and official source evidence tables.")),
        Check("Evidence confidence", all_contained(low, fixed.EVIDENCE_CONFIDENCE_TERMS), "warning", "The report distinguishes official references, processed data, rule inference, AI text and unverified inputs.", F.lit("Add O1, P2, R3, A4 and U0 provenance labels and explain their review boundaries.")),
        Check("Human review status", all_contained(low, ["human review sign-off", "draft"]), "warning", "The report includes a human review sign-off section and draft boundary.", F.lit("Add a human review sign-off section and keep unapproved outputs marked as drafts.")),
    ]


def results(text: Column) -> Column:
    """array<struct<status,name,detail>> of a text."""
    return F.array(*(
        F.struct(F.when(c.passes, "pass").otherwise(c.otherwise).alias("status"), F.lit(c.name).alias("name"), F.when(c.passes, c.good).otherwise(c.bad).alias("detail"))
        for c in checks(text)
    ))


def summary(found: Column) -> Column:
    """struct<passed,warnings,failed,total> of results()."""
    number = lambda s: F.size(F.filter(found, lambda c: c["status"] == s))
    return F.struct(number("pass").alias("passed"), number("warning").alias("warnings"), number("fail").alias("failed"), F.size(found).alias("total"))


def lint(reports: DataFrame, text: str = "text") -> DataFrame:
    """reports with checks and summary."""
    checked = reports.withColumn("checks", results(F.col(text)))
    return checked.withColumn("summary", summary(F.col("checks")))


def check_rows(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per report and check: key, check_no, name, status, detail."""
    return reports.select(key, F.posexplode(results(F.col(text)))).select(key, (F.col("pos") + 1).alias("check_no"), "col.name", "col.status", "col.detail")


def check_counts(rows: DataFrame) -> DataFrame:
    """Passes, warnings and failures of each check."""
    return rows.groupBy("name").agg(*(F.count_if(F.col("status") == s).alias(a) for s, a in (("pass", "passed"), ("warning", "warnings"), ("fail", "failed"))), F.count(F.lit(1)).alias("total"))
