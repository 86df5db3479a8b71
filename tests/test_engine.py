"""Areas, matching, ETL and the whole analysis on hand-made registers."""

from __future__ import annotations

import pytest
from fixtures import requests, rows, tables
from pyspark.sql import functions as F

from terravane import fixed, schemas
from terravane.operators import areas, etl, lineage, matching, validation
from terravane.plans import analysis


@pytest.fixture(scope="module")
def t(spark):
    return {k: v.cache() for k, v in tables(spark).items()}


@pytest.fixture(scope="module")
def profiles(spark, t):
    return analysis.profiles(requests(spark), t["regions"]).cache()


def test_area_profile(t):
    r = areas.area_profile(t["units"], "SA4", "Cairns", "Queensland").first()
    assert (r.sa2_count, r.population, r.older_people_pct, r.language_other_than_english_pct, r.language_support_needed) == (2, 1500, 13.3, 13.3, "medium")
    r = areas.area_profile(t["units"], "SA2", "none").first()
    assert (r.sa2_count, r.population, r.older_people_pct, r.language_support_needed) == (0, 0, None, "unknown")
    assert areas.matched_area_profile(t["units"], "SA2", "none").count() == 0
    assert areas.matched_area_profile(t["units"], "LGA", "Cairns").count() == 0
    assert areas.area_profile(t["units"], "LGA", "Cairns").first().sa2_count == 2  # unknown levels are SA4


def test_same_name_in_two_states(t):
    assert areas.in_area(t["units"], "SA2", "Central").count() == 2
    assert areas.in_area(t["units"], "SA2", "Central", "Victoria").count() == 1


def test_options(t):
    assert [r.area_name for r in areas.options(t["units"], "SA3", search="WAGGA").collect()] == ["Wagga Wagga"]
    assert [r.area_name for r in areas.options(t["units"], "SA4", state="Queensland").collect()] == ["Cairns", "Townsville"]
    assert [r.state_name for r in areas.states(t["units"]).collect()] == ["New South Wales", "Queensland", "Victoria"]
    assert [r.sa2_name for r in areas.configured_names(t["regions"]).collect()] == ["Edmonton", "Gordonvale", "Nowhere"]


def test_rollup_agrees_with_areas(t):
    r = areas.rollup(t["units"]).filter("sa4_name = 'Cairns' and sa3_name is null").first()
    assert (r.sa2_count, r.population) == (2, 1500)


def test_selected_areas(profiles, t):
    got = {r.request_id: r for r in areas.selected_profiles(profiles, t["units"]).collect()}
    assert set(got) == {2, 5} and got[2].language_support_needed == "medium" and got[5].population == 1500
    got = {r.request_id: r for r in areas.allocation_summary(profiles, t["allocation"]).collect()}
    assert (got[5].sa2_count, got[5].sa3_names, got[5].area_albers_sqkm, got[5].state_name) == (2, "Cairns - South", 10.12, "Queensland")


def test_allocation_names_are_gathered_once(spark, t):
    """Names come in the order of their first unit, once each, however many mesh blocks an area has."""
    columns = t["allocation"].columns
    n = 6000
    names = lambda k, c: {"state_name_2021": ["Q", "V", None][k % 3], "sa2_name_2021": f"a{k % 40}", "sa3_name_2021": ["", "x", "b", None][k // 7 % 4], "sa4_name_2021": f"s{k % 2}", "gccsa_name_2021": f"g{(k * 7) % 11}", "area_albers_sqkm": "0.5", "seq": n - k}.get(c)
    kinds = {f.name: f.dataType for f in t["allocation"].schema}
    rows_ = [tuple(str(v) if (v := names(k, c)) is not None and kinds[c].simpleString() == "string" else v for c in columns) for k in range(n)]
    table = spark.createDataFrame(rows_, t["allocation"].schema)
    asked = spark.createDataFrame([(1, ("SA4", "s0", "Q")), (2, ("SA4", "s0", None)), (3, ("SA3", "x", "")), (4, ("SA4", "s9", None))], "request_id long, area_selection struct<level:string,area_name:string,state:string>")
    out = areas.allocation_summary(asked, table)
    got = {r.request_id: r for r in out.collect()}
    plain = lambda keep: [k for k in reversed(range(n)) if keep(k)]
    first = lambda of, c: ", ".join(dict.fromkeys(x for k in of if (x := names(k, c))))
    for no, of in ((1, plain(lambda k: k % 2 == 0 and k % 3 == 0)), (2, plain(lambda k: k % 2 == 0)), (3, plain(lambda k: k // 7 % 4 == 1))):
        r = got[no]
        assert (r.sa2_count, r.sa3_names, r.sa4_names, r.gccsa_names, r.area_albers_sqkm) == (len(of), first(of, "sa3_name_2021"), first(of, "sa4_name_2021"), first(of, "gccsa_name_2021"), len(of) / 2)
    assert set(got) == {1, 2, 3} and got[1].state_name == "Q"
    # Units are summed up before they are multiplied by levels and names.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate explode") < plan.rindex("Aggregate [state_name")


def test_first_area(spark, t):
    r = spark.createDataFrame([(1, "near cairns"), (2, "wagga"), (3, ""), (4, "central"), (5, "zzz")], "request_id long, location string")
    got = {x.request_id: (x.level, x.area_name, x.state) for x in areas.first_area(r, t["units"]).collect()}
    assert got == {1: ("SA4", "Cairns", "Queensland"), 2: ("SA3", "Wagga Wagga", "New South Wales"), 4: ("SA2", "Central", "New South Wales")}
    assert {x.request_id: x.matched for x in areas.first_location(r, t["community"]).collect()} == {1: "Cairns"}


def test_profiles(profiles):
    got = {r.request_id: (r.locality, r.state, r.setting_type) for r in profiles.collect()}
    assert got[1] == ("Cairns", "Queensland", "campus") and got[2] == ("Wagga Wagga", "New South Wales", "community")
    assert got[3][1:] == ("Western Australia", "community") and got[4] == ("", "Australia", "general") and got[5][1:] == ("Victoria", "aged_care")


@pytest.mark.parametrize("place, state", [("Sydney NSW", "New South Wales"), ("Melbourne Victoria", "Victoria"), ("Hobart Tasmania", "Tasmania"), ("Wagga Wagga", "New South Wales"), ("Mount Isa, Queensland", "Queensland"), ("Wattle", "Australia"), ("actual place", "Australia"), ("Victoria Park, WA", "Victoria")])
def test_places(spark, place, state):
    r = spark.createDataFrame([(1, place)], "request_id long, location string")
    assert matching.resolved_places(r, matching.keyword_table(spark)).first().state == state


def test_rules(profiles, t):
    got = {r.request_id: r for r in matching.risk_context(profiles, t["rules"]).collect()}
    assert got[1].matched_rule_ids == ["cairns", "campus"] and got[1].risk_points == ["Cyclones.", "Heat.", "Classes."] and got[1].assumptions == ["Assume roads.", "Assume classes."]
    assert got[2].matched_rule_ids == ["wa_general"]  # short keywords match within words
    assert got[4].risk_points == [fixed.DEFAULT_RISK_POINT] and got[4].assumptions == [fixed.DEFAULT_ASSUMPTION]
    strict = {r.request_id: r.matched_rule_ids for r in matching.risk_context(profiles, t["rules"], "boundary").collect()}
    assert strict[2] == [] and strict[3] == ["wa_general"]


def test_sources(profiles, t):
    got = {r.request_id: [s.id for s in r.sources] for r in matching.selected_sources(profiles, t["sources"]).collect()}
    assert got == {1: ["bom", "qfes", "council"], 2: ["bom", "rfs"], 3: ["bom"], 4: ["bom"], 5: ["bom"]}


def test_community(profiles, t):
    got = {r.request_id: r.location for r in matching.community_matches(profiles, t["community"]).collect()}
    assert got == {1: "Cairns", 5: "Mildura"}
    notes = {r.location: r.n for r in t["community"].select("location", matching.community_notes().alias("n")).collect()}
    assert fixed.NOTE_OLDER not in notes["Cairns"] and fixed.NOTE_OLDER in notes["Mildura"] and fixed.NOTE_NO_CAR in notes["Mildura"]
    fair = {r.location: r.n for r in t["community"].select("location", matching.community_notes(False).alias("n")).collect()}
    assert fixed.NOTE_OLDER in fair["Cairns"] and fixed.NOTE_TRANSPORT in fair["Cairns"]


def test_lga(profiles, t):
    got = {r.request_id: [x.lga_code_2025 for x in r.lga_candidates] for r in matching.lga_candidates(profiles, t["lga"]).collect()}
    assert got[1] == ["1", "2", "5", "6", "7"] and got[2] == ["4"] and got[3] == ["3"] and got[4] == []


def test_priorities(spark):
    r = spark.range(1).select(matching.planning_priorities(F.array(F.lit("Evacuation"), F.lit("x"), F.lit("Evacuation")), F.lit("campus")).alias("p")).first().p
    assert r == [*fixed.PRIORITIES, fixed.CONCERN_PRIORITIES["Evacuation"], fixed.SETTING_PRIORITIES["campus"]]


def test_whole_analysis(spark, t):
    registers = analysis.Registers(t["rules"], t["sources"], t["regions"], t["community"], t["units"], t["allocation"], t["lga"])
    analysed = analysis.analyse(requests(spark), registers).cache()
    got = {r.request_id: r.analysis for r in analysed.collect()}
    assert len(got) == 5 and [e.code for e in got[1].evidence] == ["O1", "P2", "R3", "A4", "U0"]
    assert got[1].community.matched_location == "Cairns" and got[5].community.matched_location == "Cairns, Queensland" and got[4].community is None
    assert got[1].evidence[2].current_use == "2 configured rule(s) matched: cairns, campus" and "ASGS provenance" in got[5].evidence[0].current_use
    assert "Location: Cairns" not in analysis.prompts(analysed).filter("request_id = 1").first().prompt and "Cairns" in analysis.prompts(analysed).filter("request_id = 1").first().prompt
    drafts = spark.createDataFrame([(k, "# Plan\nSee http://x.y now.\n\n\n\nEnd") for k in got], "request_id long, text string")
    done = {r.request_id: r for r in analysis.finished(drafts, analysed).collect()}
    for r in done.values():
        assert r.text.count(fixed.EVIDENCE_HEADING) == 1 and r.text.count(fixed.SIGNOFF_HEADING) == 1 and r.text.startswith("**DRAFT") and "http://x.y" not in r.text and r.summary.total == 11
        assert {c.name: c.status for c in r.checks}["Evidence tables"] == "pass" and {c.name: c.status for c in r.checks}["Human review status"] == "pass"
    assert "| Matched risk rules | cairns, campus |" in done[1].text and "[U0] No LGA candidate" in done[4].text


def test_unit_profiles(spark):
    b = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C"), (None, "D")], "sa2_code_2021 string, sa2_name string")
    names = ("sa2_code_2021", "erp_p_202022", *etl.COHORTS, "census_392021")
    p = rows(spark, schemas.strings(*names), [dict(zip(names, x)) for x in (("1", "5", "9", "9", "9", "9", "9", "9"), ("1", "100", "1", "2", "", None, "3", "25"), ("2", "0", "0", "0", "0", "0", "0", "0"), (None, "7", "1", "1", "1", "1", "1", "1"))])
    got = {r.sa2_name: r for r in etl.unit_profiles(b, p).collect()}
    assert (got["A"].population, got["A"].older_people_count, got["A"].older_people_pct, got["A"].language_support_needed) == (100, 6, 6.0, "high")
    assert got["B"].population is None and got["B"].language_support_needed == "unknown" and got["C"].population is None and got["D"].population is None


def test_regions(spark, t):
    got = {r.location: r for r in etl.region_profiles(t["regions"], t["units"]).collect()}
    assert (got["Cairns"].matched_sa2_count, got["Cairns"].matched_sa2_names, got["Cairns"].population) == (2, "Edmonton; Gordonvale", 1500)
    assert (got["Mildura"].matched_sa2_count, got["Mildura"].state, got["Mildura"].language_support_needed) == (0, "Victoria", "unknown")
    f = spark.createDataFrame([("Edmonton",), ("Other",)], "sa2_name string")
    assert {r.sa2_name: r.mapped_location for r in etl.mapped_features(f, t["regions"]).collect()} == {"Edmonton": "Cairns", "Other": "Unmapped"}


def test_lga_summary(spark):
    names = ("lga_code_2025", "lga_name_2025", "state_code_2021", "state_name_2021", "area_albers_sqkm")
    a = rows(spark, schemas.LGA_ALLOCATION, [dict(zip(names, x)) for x in (("2", "B", "1", "NSW", "1.00005"), ("1", "Z", "1", "NSW", "2"), ("2", "B2", "1", "NSW", "bad"), ("", "X", "1", "NSW", "9"), ("ZZZZZ", "A", "0", "ACT", None))])
    got = [(r.lga_code_2025, r.lga_name_2025, r.mesh_block_count, r.area_albers_sqkm) for r in etl.lga_summary(a).collect()]
    assert got == [("ZZZZZ", "A", 1, 0.0), ("2", "B", 2, 1.0), ("1", "Z", 1, 2.0)] or got[1][3] == 1.0001
    c = spark.createDataFrame([("a", "x", "0.8"), ("a", "y", "0.2")], "LGA_CODE_2024 string, LGA_CODE_2025 string, RATIO_FROM_TO string")
    v = spark.createDataFrame([("a", 10.0)], "LGA_CODE_2024 string, n double")
    assert {r.LGA_CODE_2025: r.n for r in etl.apportioned(v, c, "n").collect()} == {"x": 8.0, "y": 2.0}


def test_features(spark):
    polygon, multi = "[[[1,2],[3,4],[5],[1,2]]]", "[[[[10,20],[30,40]]]]"
    shape = lambda kind, c, name, state: ("Feature", (None, name, None, "Cairns", state, None, None, "Home", None, None), (kind, c))
    df = spark.createDataFrame([("FeatureCollection", [shape("Polygon", polygon, "A", "Q"), shape("MultiPolygon", multi, "B", "Q"), shape("Point", "[1,2]", "C", "N")])], schemas.DDL["features"])
    r = areas.centre(df).first()
    assert (r.longitude, r.latitude) == (pytest.approx((1 + 3 + 1 + 10 + 30) / 5), pytest.approx((2 + 4 + 2 + 20 + 40) / 5))
    assert tuple(areas.centre(areas.features_in(df, "SA2", "C")).first()) == fixed.MAP_CENTRE
    assert areas.features_in(df, "SA4", "Cairns", "Q").select(F.size("features")).first()[0] == 2
    assert areas.features_at(df, "HOME").select(F.size("features")).first()[0] == 3


def test_lineage(spark):
    e = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("a", 4, True), ("b", 1, True)], "k string, o int, fresh boolean")
    got = [(r.k, r.o, r.version, r.parent_order) for r in lineage.versions(e, "k", "o", F.col("fresh")).orderBy("k", "o").collect()]
    assert got == [("a", 1, 1, None), ("a", 2, 2, 1), ("a", 3, 3, 2), ("a", 4, 1, None), ("b", 1, 1, None)]
    assert {r.k: r.o for r in lineage.latest(e, "k", "o").collect()} == {"a": 4, "b": 1}
    audits = spark.createDataFrame([("r1", "Draft"), ("r2", "Draft")], "report_id string, report_status string")
    reviews = spark.createDataFrame([("r1", "Approved", "2"), ("r1", "Reviewed", "1")], "report_id string, approval_status string, updated_at string")
    got = {r.report_id: r for r in lineage.review_state(audits, reviews).collect()}
    assert got["r1"].report_status == "Approved" and [x.approval_status for x in got["r1"].human_review_history] == ["Reviewed", "Approved"] and got["r2"].report_status == "Draft"
    ticks = spark.createDataFrame([([True, True],), ([True, False],), ([],), (None,)], "v array<boolean>")
    assert [r.c for r in ticks.select(lineage.checklist_complete(F.col("v")).alias("c")).collect()] == [True, False, False, False]


def test_validation(spark):
    ddl = "location string, audience string, concerns array<string>, report_status string, organisation_name string, reviewer_name string, reviewer_role string, approval_status string, review_checklist_complete boolean"
    r = spark.createDataFrame([
        (" ", "x", ["a"], None, None, None, None, None, None), ("x", "x", [], "", None, None, None, None, None), ("x", "x", ["a"], "Reviewed draft", "o", " ", None, "Reviewed draft", None),
        ("x", "x", ["a"], None, "o", "n", "r", "Approved by organisation", False), ("x", "x", ["a"], None, "o", "n", "r", "Approved by organisation", True),
    ], ddl)
    got = [tuple(x) for x in r.select(validation.request_error(), validation.review_error()).collect()]
    assert got == [(fixed.ERROR_PLACE, None), (fixed.ERROR_CONCERNS, None), (fixed.ERROR_REPORT_REVIEW + "reviewer name, reviewer role.", fixed.ERROR_REVIEW + "reviewer name, reviewer role."), (None, fixed.ERROR_CHECKLIST), (None, None)]
    s = spark.createDataFrame([("Queensland", "Victoria"), ("Australia", "Victoria"), ("Victoria", "Victoria"), ("Victoria", None)], "a string, b string")
    assert [x[0] is not None for x in s.select(validation.geography_error(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_prompts_with_a_template(spark, t):
    registers = analysis.Registers(t["rules"], t["sources"], t["regions"], t["community"], t["units"], t["allocation"], t["lga"])
    analysed = analysis.analyse(requests(spark).filter("request_id = 1"), registers)
    said = analysis.prompts(analysed, [("1. One", "Say one."), ("2. Two", "Say two.")], ["Be formal."], "Write a report.", "Reviewed by N.").first().prompt
    assert said.startswith("Write a report.\n\nReviewed by N.\n\nLocation:\nCairns") and said.endswith("Rules:\n- Be formal.")
    assert said.index("Evidence confidence and provenance:\n- O1 | ") < said.index("1. One\nRequirement: Say one.\n2. Two") < said.index(fixed.NOTICE)
