"""The analysis of requests as one lazy plan: place, sources, community, rules, priorities, evidence."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane import fixed
from terravane.functions import lint, text
from terravane.functions.expr import blank_to, strip
from terravane.operators import areas, matching


class Registers(NamedTuple):
    """The dimension tables of an analysis; see schemas."""

    rules: DataFrame
    sources: DataFrame
    regions: DataFrame
    community: DataFrame
    units: DataFrame
    allocation: DataFrame
    lga: DataFrame


def profiles(requests: DataFrame, regions: DataFrame) -> DataFrame:
    """Requests with stripped texts, setting_type and resolved locality and state."""
    r = requests.withColumns({c: strip(F.coalesce(c, F.lit(""))) for c in ("location", "audience", "scenario", "extra_context")})
    r = r.withColumn("setting_type", matching.setting_type(F.col("scenario")))
    return r.join(matching.resolved_places(r, matching.keyword_table(requests.sparkSession, regions)), "request_id")


def community(profiles: DataFrame, rows: DataFrame, units: DataFrame, compat: bool = True) -> DataFrame:
    """request_id, matched_location, indicators, notes: the selected area's profile, else the community row by name."""
    said = profiles.select("request_id", F.col("area_selection.area_name").alias("area_name"))
    own = areas.selected_profiles(profiles, units).drop("area_name").join(said, "request_id")
    # Notes on a selected area.
    picked = own.select(
        "request_id", F.when(F.col("state").isNotNull(), F.concat_ws(", ", "area_name", "state")).otherwise(F.col("area_name")).alias("matched_location"),
        F.nullif(F.col("population"), F.lit(0)).cast("string").alias("population"), F.col("older_people_pct").cast("string").alias("older_people_pct"),
        F.lit("").alias("no_car_households_pct"), "language_support_needed", F.col("language_other_than_english_pct").cast("string").alias("language_other_than_english_pct"),
        F.col("sa2_count").cast("string").alias("matched_sa2_count"),
        F.array_compact(F.array(
            F.concat(F.lit("User selected "), "level", F.lit(" area '"), "area_name", F.lit("' from the all-Australia ABS SA2 dataset.")),
            F.concat(F.lit("The selected area aggregates "), "sa2_count", F.lit(" SA2 profile row(s).")), F.lit(fixed.NOTE_TRANSPORT_AREA),
            F.when(F.col("older_people_pct") >= fixed.OLDER_PEOPLE_LIMIT, fixed.NOTE_OLDER), F.when(F.col("language_support_needed").isin("medium", "high"), fixed.NOTE_LANGUAGE_AREA),
        )).alias("vulnerability_notes"),
        F.lit("Community profile loaded from the all-area SA2 profile table.").alias("data_source_note"),
    )
    matched = matching.community_matches(profiles, rows)
    note = F.when(blank_to(F.col("source"), "") != "", F.concat(F.lit("Community profile loaded: "), "source", F.coalesce(F.concat(F.lit(" ("), "source_years", F.lit(")")), F.lit("")), F.lit("."))).otherwise(
        "Sample community profile data for prototype use. Replace with ABS Census/Data by Region for real analysis."
    )
    by_name = matched.select(
        "request_id", F.col("location").alias("matched_location"), "population", "older_people_pct", "no_car_households_pct", "language_support_needed",
        "language_other_than_english_pct", "matched_sa2_count", matching.community_notes(compat).alias("vulnerability_notes"), note.alias("data_source_note"),
    )
    fallback = by_name.join(picked.select("request_id"), "request_id", "left_anti")
    return picked.unionByName(fallback)


def analyse(requests: DataFrame, r: Registers, mode: str = "substring", compat: bool = True) -> DataFrame:
    """request_id and analysis, a struct with all results, for every request."""
    p = profiles(requests, r.regions)
    area = areas.allocation_summary(p, r.allocation)
    own = community(p, r.community, r.units, compat)
    risk = matching.risk_context(p, r.rules, mode)
    found = (
        p.join(matching.selected_sources(p, r.sources), "request_id")
        .join(risk, "request_id")
        .join(matching.lga_candidates(p, r.lga), "request_id")
        .join(own.select("request_id", F.struct(*[c for c in own.columns if c != "request_id"]).alias("community")), "request_id", "left")
        .join(area.withColumn("source_file", F.lit("sa2_to_sa3_sa4_state_2021.csv")).select("request_id", F.struct(*[c for c in area.columns if c != "request_id"], "source_file").alias("area")), "request_id", "left")
    )
    asgs = F.coalesce(F.concat(F.lit("; ASGS provenance recorded from "), "area.source_file"), F.lit(""))
    place = F.coalesce("community.matched_location", F.lit("No community profile matched"))
    n = F.size("matched_rule_ids")
    # Current uses of the evidence codes.
    uses = {
        "O1": F.concat(F.size("sources"), F.lit(" official entry-point reference(s) selected"), asgs),
        "P2": F.concat(F.lit("Community context: "), place, F.coalesce(F.concat(F.lit("; "), "community.data_source_note"), F.lit(""))),
        "R3": F.when(n > 0, F.concat(n, F.lit(" configured rule(s) matched: "), F.array_join("matched_rule_ids", ", "))).otherwise("No configured local rule matched; generic planning fallback used"),
        "A4": F.lit("The configured language model produces the narrative draft after deterministic analysis."),
        "U0": F.concat(F.lit("Location: "), blank_to(F.col("location"), "not provided"), F.lit("; audience: "), blank_to(F.col("audience"), "not provided")),
    }
    analysis = F.struct(
        F.struct("location", "locality", "state", "audience", "scenario", "setting_type", "concerns", "timeframe", "extra_context").alias("profile"),
        F.struct("sources", F.array(*map(F.lit, fixed.DATA_LIMITATIONS)).alias("data_limitations")).alias("sources"), "community", "area", "lga_candidates",
        F.array(*map(F.lit, fixed.GEOGRAPHY_LIMITATIONS)).alias("area_limitations"), F.struct("matched_rule_ids", "risk_points", "assumptions").alias("risk"),
        F.struct(matching.planning_priorities(F.col("concerns"), F.col("setting_type")).alias("planning_priorities"), n.alias("risk_rule_count")).alias("plan"),
        matching.evidence_rows(uses).alias("evidence"),
    )
    return found.select("request_id", analysis.alias("analysis"))


def prompts(analysed: DataFrame, sections: Sequence[tuple[str, str]] = (), rules: Sequence[str] = (), task: str = "", governance: str = "") -> DataFrame:
    """request_id and prompt: the analysis as context for a language model.

    task stands first and governance next; sections, the report's template as (title, requirement), are asked for in
    their order, and rules of form and safety come last, after the notice that a report begins with.
    """
    a = lambda path: F.col(f"analysis.{path}")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    parts = {
        "Location": a("profile.location"), "State": a("profile.state"), "Audience": a("profile.audience"), "Scenario": a("profile.scenario"), "Timeframe": a("profile.timeframe"),
        "Concerns": F.array_join(a("profile.concerns"), ", "), "Risk context": listed(a("risk.risk_points")), "Assumptions": listed(a("risk.assumptions")),
        "Planning priorities": listed(a("plan.planning_priorities")), "Vulnerability notes": listed(a("community.vulnerability_notes")),
        "Official sources": listed(F.transform(a("sources.sources"), lambda s: F.concat_ws(": ", s["name"], s["purpose"]))), "Extra context": a("profile.extra_context"),
    }
    codes = F.array_join(F.transform(a("evidence"), lambda e: F.concat(F.lit("- "), F.concat_ws(" | ", *(e[k] for k in ("code", "evidence_class", "confidence_boundary", "required_review", "current_use"))))), "\n")
    if sections:
        parts["Evidence confidence and provenance"] = codes
        parts["Report structure, complete and in this order"] = F.lit("\n".join(f"{title}\nRequirement: {wanted}" for title, wanted in sections))
    if rules:
        parts["Notice at the start"] = F.lit(fixed.NOTICE)
        parts["Rules"] = F.lit("\n".join(f"- {x}" for x in rules))
    head = [F.lit(x) for x in (task, governance) if x]
    return analysed.select("request_id", F.concat_ws("\n\n", *head, text.prompt(parts)).alias("prompt"))


def finished(drafts: DataFrame, analysed: DataFrame) -> DataFrame:
    """Drafts (request_id, text) cleaned, governed, with evidence and sign-off, and linted."""
    joined = drafts.join(analysed, "request_id")
    body = text.governed(text.clean_model_output(F.col("text")))
    body = text.with_section(body, fixed.EVIDENCE_HEADING, text.evidence_tables())
    body = text.with_signoff(body, {"approval_status": F.lit(fixed.DRAFT_STATUS)})
    return lint.lint(joined.select("request_id", body.alias("text")))
