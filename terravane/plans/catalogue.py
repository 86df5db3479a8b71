"""The query catalogue on the star-schema tables, with the SQL that checks each query.

region stands for SA4, nation for SA3, customer for units, lineitem for mesh blocks, conversations for the
version log, events for probes. Reports are synthesised from conversations, so that checks vary.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane import fixed, schemas
from terravane.functions import lint, text
from terravane.functions.expr import elapsed_ms, first_error, missing_terms, ordered_distinct, slug, support_band, terms_found
from terravane.operators import areas, etl, lineage, matching, published, sinks
from terravane.operators.containing import overlapping
from terravane.operators.keywords import owners_found
from terravane.streaming import alerts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def units(spark: SparkSession, d: str) -> DataFrame:
    """customer with the hierarchy's names; the small sides are dimensions of fixed size (5 and 25 rows)."""
    n = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))


UNITS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


# customer as SA2 units: counts from its keys, as text, some blank or unreadable. Totals are exact; the percentages of these tables are no ties.
_SA2 = f"""sa2 AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'Even' ELSE 'Odd' END AS state_name, r_name AS sa4_name, n_name AS sa3_name, CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 900 + c_custkey % 501 END AS population,
    c_custkey % 97 AS older, CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE n_nationkey * 10 + c_custkey % 7 END AS language FROM {UNITS})"""
_PCT = lambda x: f"CASE WHEN sum(population) > 0 THEN round(100.0::DOUBLE * sum({x}) / sum(population), 1) END"
_INDICATORS = f"""count(*) AS sa2_count, sum(population)::BIGINT AS population, {_PCT("older")} AS older_people_pct, {_PCT("language")} AS language_other_than_english_pct,
    CASE WHEN sum(population) = 0 THEN 'unknown' WHEN {_PCT("language")} >= 20 THEN 'high' WHEN {_PCT("language")} >= 8 THEN 'medium' ELSE 'low' END AS language_support_needed"""
SHOWN = ("sa2_count", "population", "older_people_pct", "language_other_than_english_pct", "language_support_needed")


def sa2(spark: SparkSession, d: str) -> DataFrame:
    no, n = F.col("c_custkey"), F.col("n_nationkey")
    return units(spark, d).select(
        F.when(n % 2 == 0, "Even").otherwise("Odd").alias("state_name"), F.col("r_name").alias("sa4_name"), F.col("n_name").alias("sa3_name"), F.col("c_name").alias("sa2_name"),
        F.when(no % 13 == 0, "").otherwise((900 + no % 501).cast("string")).alias("population"), (no % 97).cast("string").alias("older_people_count"),
        F.when(no % 17 == 0, "n/a").otherwise((n * 10 + no % 7).cast("string")).alias("language_other_than_english_count"), no.alias("seq"),
    )


@query("q01_area_rollup", f"WITH {_SA2} SELECT sa4_name AS area_name, {_INDICATORS} FROM sa2 GROUP BY sa4_name")
def area_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Every SA4 as a selected area, in one aggregate."""
    names = t(spark, d, "region").select(F.col("r_regionkey").alias("request_id"), F.struct(F.lit("SA4").alias("level"), F.col("r_name").alias("area_name"), F.lit("").alias("state")).alias("area_selection"))
    return areas.selected_profiles(names, sa2(spark, d)).select("area_name", *SHOWN)


@query("q02_area_global_empty", "SELECT 'SA3' AS selected_level, 'NOWHERE' AS selected_area, 0::BIGINT AS sa2_count, 0::BIGINT AS population, NULL::DOUBLE AS older_people_pct, NULL::DOUBLE AS language_other_than_english_pct, 'unknown' AS language_support_needed")
def area_global_empty(spark: SparkSession, d: str) -> DataFrame:
    """A row even where nothing matches; the strict profile adds none."""
    none = areas.matched_area_profile(sa2(spark, d), "SA3", "NOWHERE")
    return areas.area_profile(sa2(spark, d), "SA3", "NOWHERE").unionByName(none)


@query("q03_band", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'unknown' WHEN c_acctbal / 100 >= 20 THEN 'high' WHEN c_acctbal / 100 >= 8 THEN 'medium' ELSE 'low' END AS band FROM customer")
def band(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", support_band(F.col("c_acctbal") / 100, F.col("c_nationkey")).alias("band"))


@query("q04_option_search", "SELECT DISTINCT n_name AS area_name FROM nation WHERE contains(lower(n_name), 'n') AND n_name <> ''")
def option_search(spark: SparkSession, d: str) -> DataFrame:
    named = t(spark, d, "nation").select(F.col("n_name").alias("sa3_name"), F.lit("any").alias("state_name"))
    return areas.options(named, "SA3", search="N")


@query(
    "q05_left_profile",
    """WITH p AS (SELECT CAST(s_nationkey AS VARCHAR) AS code, arg_max(s_suppkey * 10 + 7, s_suppkey) AS n, arg_max(s_suppkey * 2 + 1, s_suppkey) AS older, arg_max(s_suppkey, s_suppkey) AS language FROM supplier GROUP BY ALL)
    SELECT CAST(n_nationkey AS VARCHAR) AS sa2_code_2021, n_name AS sa2_name, n AS population, older AS older_people_count, round(100 * older / n, 1) AS older_people_pct, nullif(language, 0) AS language_other_than_english_count,
    round(100 * language / n, 1) AS language_other_than_english_pct, CASE WHEN n IS NULL THEN 'unknown' WHEN round(100 * language / n, 1) >= 8 THEN 'medium' ELSE 'low' END AS language_support_needed FROM nation LEFT JOIN p ON code = CAST(n_nationkey AS VARCHAR)""",
)
def left_profile(spark: SparkSession, d: str) -> DataFrame:
    """Units with the last population row of their code; supplier stands for the population service."""
    text_of = lambda x: x.cast("string")
    no = F.col("s_suppkey")
    cohorts = [text_of(no), text_of(no), F.lit("1"), F.lit(""), F.lit(None).cast("string")]
    right = t(spark, d, "supplier").select(text_of(F.col("s_nationkey")).alias("sa2_code_2021"), text_of(no * 10 + 7).alias("erp_p_202022"), *(c.alias(k) for c, k in zip(cohorts, etl.COHORTS)), text_of(no).alias("census_392021"), no.alias("seq"))
    left = t(spark, d, "nation").select(text_of(F.col("n_nationkey")).alias("sa2_code_2021"), F.col("n_name").alias("sa2_name"))
    return etl.unit_profiles(left, right)


REGION_KEYS = [("north", [1, 2, 3, 3]), ("south", [3, 7, 99]), ("nowhere", [77])]
_REGION_SQL = " UNION ALL ".join(f"SELECT {q(k)} AS location, {v} AS keys" for k, v in REGION_KEYS)


@query(
    "q06_region_map",
    f"""WITH m AS ({_REGION_SQL}), x AS (SELECT location, unnest(list_distinct(keys)) AS k FROM m), y AS (SELECT location, 'NATION_' || k AS sa2_name FROM x),
    u AS (SELECT 'NATION_' || n_nationkey AS sa2_name, n_nationkey * 100 AS population, n_nationkey * 9 AS older FROM nation),
    z AS (SELECT location, coalesce(sum(population), 0)::BIGINT AS population, sum(older) AS older, count(population) AS matched_sa2_count, coalesce(string_agg(CASE WHEN population IS NOT NULL THEN sa2_name END, '; ' ORDER BY sa2_name), '') AS matched_sa2_names FROM y LEFT JOIN u USING (sa2_name) GROUP BY location)
    SELECT location, population, CASE WHEN population > 0 THEN round(100 * older / population, 1) END AS older_people_pct, matched_sa2_count, matched_sa2_names FROM z""",
)
def region_map(spark: SparkSession, d: str) -> DataFrame:
    """Configured regions with their units' indicators, also where no unit matches."""
    made = [(k, "any", "SA2", None, "name", "n", [f"NATION_{x}" for x in keys], i) for i, (k, keys) in enumerate(REGION_KEYS)]
    regions = spark.createDataFrame(made, schemas.DDL["regions"] + ", seq long")
    no = F.col("n_nationkey")
    units_ = t(spark, d, "nation").select(
        F.concat(F.lit("NATION_"), no).alias("sa2_name"), (no * 100).cast("string").alias("population"), (no * 9).cast("string").alias("older_people_count"), F.lit("").alias("language_other_than_english_count")
    )
    return etl.region_profiles(regions, units_).select("location", "population", "older_people_pct", "matched_sa2_count", "matched_sa2_names")


@query(
    "q07_alloc_group",
    """SELECT CAST(l_suppkey AS VARCHAR) AS lga_code_2025, arg_min(l_returnflag, o) AS lga_name_2025, arg_min(l_linestatus, o) AS state_code_2021, arg_min(l_returnflag || l_linestatus, o) AS state_name_2021, count(*) AS mesh_block_count,
    sum(CASE WHEN l_linenumber < 7 THEN CAST(l_quantity AS BIGINT) ELSE 0 END)::DOUBLE AS area_albers_sqkm FROM (SELECT *, l_orderkey * 100 + l_linenumber AS o FROM lineitem) WHERE l_suppkey % 11 <> 0 GROUP BY l_suppkey""",
)
def alloc_group(spark: SparkSession, d: str) -> DataFrame:
    """Mesh blocks by area code: blank codes go, unreadable areas count zero, first names stay."""
    code = F.when(F.col("l_suppkey") % 11 == 0, "").otherwise(F.col("l_suppkey").cast("string"))
    area = F.when(F.col("l_linenumber") < 7, F.col("l_quantity").cast("long").cast("string")).otherwise("n/a")
    rows = t(spark, d, "lineitem").select(
        code.alias("lga_code_2025"), F.col("l_returnflag").alias("lga_name_2025"), F.col("l_linestatus").alias("state_code_2021"), F.concat("l_returnflag", "l_linestatus").alias("state_name_2021"),
        area.alias("area_albers_sqkm"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )
    return etl.lga_summary(rows)


KEYWORDS = ["licensed", "the ", "ción", "heit", "trash"]
_KEYWORD_SQL = " UNION ALL ".join(f"SELECT {k} AS rule_no, {q(w)} AS kw" for k, w in enumerate(KEYWORDS))


@query("q08_rule_match", f"WITH r AS ({_KEYWORD_SQL}) SELECT doc_id, rule_no FROM documents JOIN r ON contains(lower(text), kw)")
def rule_match(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("said", w, False, k) for k, w in enumerate(KEYWORDS)], "field string, keyword string, alone boolean, owner long")
    docs = t(spark, d, "documents").select("doc_id", F.lower("text").alias("said"))
    return owners_found(docs, rules).select("doc_id", F.col("owner").cast("int").alias("rule_no"))


SOURCE_TAGS = [("national", ["australia"]), ("qld", ["queensland", "qld"]), ("nsw", ["nsw"]), ("one", ["nation_1", "nation_4"]), ("none", ["nowhere"])]
_SOURCE_SQL = " UNION ALL ".join(f"SELECT {i} AS seq, {q(k)} AS id, {v} AS scope" for i, (k, v) in enumerate(SOURCE_TAGS))


@query(
    "q09_tag_overlap",
    f"""WITH s AS ({_SOURCE_SQL}) SELECT n_nationkey AS request_id, string_agg(id, ',' ORDER BY seq) AS ids FROM nation JOIN s ON list_has_any(scope,
    ['australia', CASE n_nationkey % 3 WHEN 0 THEN 'queensland' WHEN 1 THEN 'new_south_wales' END, CASE n_nationkey % 3 WHEN 0 THEN 'qld' WHEN 1 THEN 'nsw' END, lower(n_name)]) GROUP BY n_nationkey""",
)
def tag_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a tag of the resolved place in common; national ones always."""
    register = spark.createDataFrame([(k, k, "", scope, "", "", i) for i, (k, scope) in enumerate(SOURCE_TAGS)], schemas.DDL["sources"] + ", seq long")
    state = F.element_at(F.array(F.lit("Queensland"), F.lit("New South Wales"), F.lit(fixed.DEFAULT_STATE)), (F.col("n_nationkey") % 3 + 1).cast("int"))
    places = t(spark, d, "nation").select(F.col("n_nationkey").alias("request_id"), state.alias("state"), F.col("n_name").alias("locality"))
    found = matching.selected_sources(places, register)
    return found.select("request_id", F.array_join(F.transform("sources", lambda x: x["id"]), ",").alias("ids"))


NEEDLES = [(0, "indonesia and japan"), (1, "united"), (2, "zzz"), (3, "nation_1"), (4, "asia"), (5, "")]
_NEEDLE_SQL = " UNION ALL ".join(f"SELECT {k} AS request_id, {q(w)} AS said" for k, w in NEEDLES)


@query(
    "q10_bidir_first",
    f"""WITH n AS ({_NEEDLE_SQL}), a AS (SELECT 1 AS tier, r_regionkey AS seq, r_name AS name FROM region UNION ALL SELECT 2, n_nationkey, n_name FROM nation),
    m AS (SELECT request_id, tier, name, row_number() OVER (PARTITION BY request_id ORDER BY tier, seq) AS k FROM n JOIN a ON said <> '' AND (contains(said, lower(name)) OR contains(lower(name), said)))
    SELECT request_id, tier, name FROM m WHERE k = 1""",
)
def bidir_first(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(NEEDLES, "request_id int, said string")
    named = t(spark, d, "region").select(F.lit(1).alias("tier"), F.col("r_regionkey").alias("seq"), F.col("r_name").alias("name"))
    named = named.unionByName(t(spark, d, "nation").select(F.lit(2).alias("tier"), F.col("n_nationkey").alias("seq"), F.col("n_name").alias("name")))
    low = named.withColumn("other", F.lower("name"))
    pairs = overlapping(asked.select(F.col("said").alias("text")).distinct(), low.select(F.col("other").alias("text")).distinct())
    hit = asked.join(pairs, F.col("said") == F.col("one")).join(low, "other")
    return hit.groupBy("request_id").agg(F.min_by(F.struct("tier", "name"), F.struct("tier", "seq")).alias("x")).select("request_id", "x.*")


@query(
    "q11_lga_top5",
    "SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer WHERE contains(c_name, '1') AND c_mktsegment = 'BUILDING') WHERE k <= 5",
)
def lga_top5(spark: SparkSession, d: str) -> DataFrame:
    hit = t(spark, d, "customer").filter(F.contains("c_name", F.lit("1")) & (F.col("c_mktsegment") == "BUILDING"))
    return areas.first_per(hit, "c_nationkey", 5, "c_custkey").select("c_nationkey", "c_custkey", "c_name")


TIERS = [(1, 0, "sa", "South Australia"), (1, 1, "victoria", "Victoria"), (2, 0, "perth", "Western Australia"), (2, 1, "10", "Ten"), (3, 0, "0", "Zero")]
_TIER_SQL = " UNION ALL ".join(f"SELECT {a} AS tier, {b} AS ord, {q(k)} AS kw, {q(s)} AS state" for a, b, k, s in TIERS)


@query(
    "q12_tiered_resolve",
    f"""WITH k AS ({_TIER_SQL}), c AS (SELECT c_custkey, lower(c_name) AS said FROM customer),
    m AS (SELECT c_custkey, arg_min(state, tier * 100 + ord) AS state FROM c JOIN k ON CASE WHEN length(kw) <= 3 THEN regexp_matches(said, '(^|[^a-z])' || kw || '([^a-z]|$)') ELSE contains(said, kw) END GROUP BY c_custkey)
    SELECT c.c_custkey, coalesce(m.state, 'Australia') AS state FROM c LEFT JOIN m USING (c_custkey)""",
)
def tiered_resolve(spark: SparkSession, d: str) -> DataFrame:
    k = spark.createDataFrame([("said", w, len(w) <= 3, i, s) for i, (_, _, w, s) in enumerate(sorted(TIERS))], "field string, keyword string, alone boolean, owner long, state string")
    c = t(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("said"))
    hit = owners_found(c, k.drop("state"), first=True).select("c_custkey", "owner").join(k, "owner").select("c_custkey", "state")
    return c.select("c_custkey").join(hit, "c_custkey", "left").select("c_custkey", F.coalesce("state", F.lit(fixed.DEFAULT_STATE)).alias("state"))


_PLACE_SQL = " UNION ALL ".join(
    [f"SELECT {tier} AS tier, {k} AS ord, {q(w)} AS kw, {q(s)} AS state, NULL AS locality" for tier, table in ((2, fixed.STATE_KEYWORDS), (3, fixed.CITY_KEYWORDS)) for k, (s, w) in enumerate((s, w) for s, ws in table.items() for w in ws)]
)


@query(
    "q48_resolved_places",
    f"""WITH k AS (SELECT 1 AS tier, n_nationkey AS ord, lower(n_name) AS kw, r_name AS state, n_name AS locality FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 UNION ALL {_PLACE_SQL}),
    c AS (SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN 'Perth, WA' WHEN 1 THEN 'wattle act' WHEN 2 THEN 'near ' || n_name ELSE c_name || ' Hobart' END AS location FROM customer JOIN nation ON c_nationkey = n_nationkey),
    m AS (SELECT request_id, arg_min(state, tier * 1000 + ord) AS state, min(tier * 1000 + ord) AS o FROM c JOIN k ON CASE WHEN tier = 2 AND length(kw) <= 3 THEN regexp_matches(lower(location), '(^|[^a-z])' || kw || '([^a-z]|$)') ELSE contains(lower(location), kw) END GROUP BY request_id)
    SELECT c.request_id, coalesce(k.locality, c.location) AS locality, coalesce(m.state, {q(fixed.DEFAULT_STATE)}) AS state FROM c LEFT JOIN m USING (request_id) LEFT JOIN (SELECT DISTINCT tier * 1000 + ord AS o, locality FROM k) k USING (o)""",
)
def resolved_places(spark: SparkSession, d: str) -> DataFrame:
    """The place and state of each request: configured places, then states, then cities."""
    n = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = n.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("location"), F.col("r_name").alias("state"))
    no = F.col("c_custkey")
    said = F.when(no % 5 == 0, "Perth, WA").when(no % 5 == 1, "wattle act").when(no % 5 == 2, F.concat(F.lit("near "), "n_name")).otherwise(F.concat("c_name", F.lit(" Hobart")))
    return matching.resolved_places(units(spark, d).select(no.alias("request_id"), said.alias("location")), matching.keyword_table(spark, regions))


@query(
    "q13_ordered_union",
    "WITH x AS (SELECT conv_id, role, min(turn) AS o FROM conversations WHERE role IS NOT NULL AND role <> '' GROUP BY conv_id, role) SELECT conv_id, string_agg(role, ', ' ORDER BY o, role) AS roles FROM x GROUP BY conv_id",
)
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    first = t(spark, d, "conversations").filter("role <> ''").groupBy("conv_id", "role").agg(F.min("turn").alias("o"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("o", "role"))), lambda x: x["role"])
    return first.groupBy("conv_id").agg(F.array_join(ordered_distinct(own), ", ").alias("roles"))


TERMS = ["the", "ción", "Licensed", "nicht", "000"]
_HAS = lambda w: f"contains(lower(text), {q(w.lower())})"


@query(
    "q14_except_terms",
    f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN NOT {_HAS(w)} THEN {q(w)} END' for w in TERMS)}], lambda x: x IS NOT NULL), ', ') AS missing, {' + '.join(f'CAST({_HAS(w)} AS INTEGER)' for w in TERMS)} AS found FROM documents",
)
def except_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    return docs.select("doc_id", F.array_join(missing_terms(F.col("low"), TERMS), ", ").alias("missing"), terms_found(F.col("low"), TERMS).alias("found"))


@query(
    "q15_probe_summary",
    "SELECT user_id % 10 AS source, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS reachable, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) - count(*) FILTER (WHERE event_type = 'click') - count(*) FILTER (WHERE event_type = 'error') AS warnings FROM events GROUP BY ALL",
)
def probe_summary(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "Reachable").when(F.col("event_type") == "error", "Check failed").otherwise("Check warning")
    return lineage.probe_summary(t(spark, d, "events").select((F.col("user_id") % 10).alias("source"), status.alias("status")), "source")


# Synthesised reports: all lines, less one section by conversation.
PARTS = [
    "# Plan\\n## Executive Summary\\nPurpose and Scope.\\n", "## Selected Geography\\nASGS, Data Sources, Local Risk Context. Community Indicators. Official Source Register.\\n",
    "## Evacuation\\nAssembly Point at the library is confirmed safe.\\n", "## Roles\\nTeacher, student, first aid, communication.\\n| Role | Who |\\n| --- | --- |\\n| Lead | A |\\n",
    "## Action Plan\\nDay 1: call 000.\\n", "## Checklist\\n- [ ] Bureau of Meteorology\\n- local council\\n1. fire service\\n",
    "## Evidence Tables\\nEvidence Confidence and Provenance: O1 P2 R3 A4 U0\\n", "## Safety Disclaimer\\nOfficial live evacuation order. state emergency\\n", "## Human Review Sign-off\\ndraft\\n",
]
PLAIN_PARTS = [p.replace("\\n", "\n") for p in PARTS]
_REPORTS = (
    "reports AS (SELECT conv_id, concat(" + ", ".join(f"CASE WHEN conv_no % 10 <> {k} THEN replace({q(p)}, '\\n', chr(10)) ELSE '' END" for k, p in enumerate(PARTS))
    + ") AS text FROM (SELECT conv_id, CAST(hash_no AS BIGINT) AS conv_no FROM (SELECT DISTINCT conv_id, length(CAST(conv_id AS VARCHAR)) * 7 + ascii(right(CAST(conv_id AS VARCHAR), 1)) AS hash_no FROM conversations)))"
)


def reports(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").select("conv_id").distinct()
    name = F.col("conv_id").cast("string")
    no = F.length(name) * 7 + F.ascii(F.right(name, F.lit(1)))
    return c.select("conv_id", F.concat(*(F.when(no % 10 != k, p).otherwise("") for k, p in enumerate(PLAIN_PARTS))).alias("text"))


def _all(terms: list[str]) -> str:
    return "(" + " AND ".join(_HAS(x) for x in terms) + ")"


def _least(terms: list[str], n: int) -> str:
    return "(" + " + ".join(f"CAST({_HAS(x)} AS INTEGER)" for x in terms) + f" >= {n})"


def _some(terms: list[str]) -> str:
    return "(" + " OR ".join(_HAS(x) for x in terms) + ")"


_CHECKS = [
    ("Required sections", _all(fixed.REQUIRED_SECTIONS), "warning"), ("Official sources", _least(fixed.OFFICIAL_SOURCE_TERMS, 4), "warning"),
    ("Safety disclaimer", _all(fixed.DISCLAIMER_TERMS), "fail"), ("Emergency number 000", "contains(text, '000')", "fail"), ("Action plan", _all(["action plan", "day 1"]), "warning"),
    ("Checklist", "(contains(lower(text), 'checklist') AND (contains(text, '- [ ]') OR contains(lower(text), '- [x]')))", "warning"), ("Roles and responsibilities", _least(fixed.ROLE_TERMS, 4), "warning"),
    ("Assembly point wording", f"NOT ({_some(fixed.PLACE_TERMS)} AND {_some(fixed.CONFIRMATION_TERMS)})", "fail"), ("Evidence tables", _all(fixed.EVIDENCE_TABLE_TERMS), "warning"),
    ("Evidence confidence", _all(fixed.EVIDENCE_CONFIDENCE_TERMS), "warning"), ("Human review status", _all(["human review sign-off", "draft"]), "warning"),
]
_LINT = f"WITH {_REPORTS}, lint AS (" + " UNION ALL ".join(f"SELECT conv_id, {k} AS check_no, {q(n)} AS name, CASE WHEN {c} THEN 'pass' ELSE {q(s)} END AS status FROM reports" for k, (n, c, s) in enumerate(_CHECKS, 1)) + ") "


@query("q16_lint_rows", _LINT + "SELECT conv_id, check_no, name, status FROM lint")
def lint_rows(spark: SparkSession, d: str) -> DataFrame:
    return lint.check_rows(reports(spark, d), "conv_id").drop("detail")


@query(
    "q17_lint_rollup",
    _LINT + "SELECT name, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'warning') AS warnings, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) AS total FROM lint GROUP BY name",
)
def lint_rollup(spark: SparkSession, d: str) -> DataFrame:
    return lint.check_counts(lint.check_rows(reports(spark, d), "conv_id"))


@query("q18_latest_version", "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    said = t(spark, d, "conversations").filter("role = 'assistant'")
    return lineage.latest(said, "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query(
    "q19_lineage",
    "SELECT conv_id, turn, row_number() OVER w AS version, lag(turn) OVER w AS parent_turn FROM conversations WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def version_chain(spark: SparkSession, d: str) -> DataFrame:
    said = t(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn")
    return lineage.versions(said, "conv_id", "turn").select("conv_id", "turn", F.col("version").cast("long").alias("version"), F.col("parent_order").alias("parent_turn"))


@query("q20_slug", "SELECT c_custkey, coalesce(nullif(left(trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_'), 24), ''), 'unknown') AS slug FROM customer")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", slug(F.concat_ws(" / ", "c_name", "c_mktsegment"), 24).alias("slug"))


@query("q21_url_mask", "SELECT page_id, regexp_replace(url, 'https?://\\S+', '[verify through the relevant official source]', 'g') AS masked FROM pages")
def url_mask(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", text.clean_model_output(F.col("url")).alias("masked"))


@query(
    "q22_section_cut",
    f"""WITH {_REPORTS}, x AS (SELECT conv_id, text, instr(text, '## Roles') AS a FROM reports),
    y AS (SELECT *, CASE WHEN a > 0 THEN instr(substr(text, a + 8), chr(10) || '## ') ELSE 0 END AS b FROM x)
    SELECT conv_id, CASE WHEN a = 0 THEN text WHEN b = 0 THEN rtrim(substr(text, 1, a - 1), ' ' || chr(10)) ELSE rtrim(substr(text, 1, a - 1), ' ' || chr(10)) || chr(10) || chr(10) || ltrim(substr(text, a + 8 + b), ' ' || chr(10)) END AS cut FROM y""",
)
def section_cut(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d).select("conv_id", text.remove_section(F.col("text"), "## Roles").alias("cut"))


@query(
    "q23_vertex_mean",
    "WITH p AS (SELECT unnest([vec_id % 90, (vec_id + label) % 90]) AS x, unnest([vec_id % 45, -label]) AS y FROM embeddings) SELECT CAST(round(avg(x) * 1000000) AS BIGINT) AS lon_micro, CAST(round(avg(y) * 1000000) AS BIGINT) AS lat_micro FROM p",
)
def vertex_mean(spark: SparkSession, d: str) -> DataFrame:
    """The map centre of features, a polygon or multi-polygon of two points for each vector; short points don't count."""
    a, b, c = F.col("vec_id") % 90, F.col("vec_id") % 45, F.col("label")
    ring = F.concat(F.lit("[["), F.concat_ws("],[", F.concat_ws(",", a, b), F.concat_ws(",", (F.col("vec_id") + c) % 90, -c), F.lit("7")), F.lit("]]"))
    multi = F.col("vec_id") % 2 == 1
    shape = F.struct(F.when(multi, "MultiPolygon").otherwise("Polygon").alias("type"), F.when(multi, F.concat(F.lit("[["), ring, F.lit("]]"))).otherwise(F.concat(F.lit("["), ring, F.lit("]"))).alias("coordinates"))
    found = areas.centre(t(spark, d, "embeddings").select(F.array(F.struct(shape.alias("geometry"))).alias("features")))
    return found.select(*(F.round(F.col(x) * 1000000).cast("long").alias(y) for x, y in (("longitude", "lon_micro"), ("latitude", "lat_micro"))))


@query("q24_json_field", "SELECT event_id, json_extract_string(props, '$.page') AS page, props IS NULL AS missing FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.col("props").isNull().alias("missing"))


@query(
    "q25_md_blocks",
    f"""WITH {_REPORTS}, l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM reports)
    SELECT conv_id, CASE WHEN line LIKE '|%|' THEN 'table' WHEN line LIKE '### %' THEN 'h3' WHEN line LIKE '## %' THEN 'h2' WHEN line LIKE '# %' THEN 'h1' WHEN regexp_matches(line, '^[-*] \\[[ xX]\\] ') THEN 'checkbox'
    WHEN regexp_matches(line, '^[-*] ') THEN 'bullet' WHEN regexp_matches(line, '^\\d+\\.\\s+') THEN 'numbered' ELSE 'paragraph' END AS kind, count(*) AS lines FROM l WHERE trim(line) <> '' GROUP BY ALL""",
)
def md_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = text.blocks(reports(spark, d), "conv_id")
    return found.groupBy("conv_id", "kind").agg(F.sum(F.size("lines")).alias("lines"))


@query("q26_horizontal_sum", "SELECT l_orderkey, l_linenumber, coalesce(l_partkey, 0) + coalesce(l_suppkey, 0) + coalesce(l_linenumber, 0) AS total FROM lineitem")
def horizontal_sum(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", etl.sum_of(["l_partkey", "l_suppkey", "l_linenumber"]).alias("total"))


@query(
    "q27_validation",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 200000 THEN 'too dear' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS error FROM orders",
)
def validation(spark: SparkSession, d: str) -> DataFrame:
    tests = ((F.col("o_orderstatus") == "P", "pending"), (F.col("o_totalprice") > 200000, "too dear"), (F.col("o_orderpriority") == "1-URGENT", "urgent"))
    return t(spark, d, "orders").select("o_orderkey", first_error(*tests).alias("error"))


@query("q28_partition_counts", f"SELECT CASE WHEN r_name = 'ASIA' THEN 'Unknown' ELSE r_name END AS state, count(*) AS features, min(c_custkey) AS first_key FROM {UNITS} GROUP BY ALL")
def partition_counts(spark: SparkSession, d: str) -> DataFrame:
    """Feature collections by state, in parts of bounded size, read back."""
    state = F.when(F.col("r_name") == "ASIA", "").otherwise(F.col("r_name"))
    made = sinks.collections(units(spark, d).select(state.alias("state"), F.struct("c_custkey").alias("feature")), "feature", most=1000)
    kept = made.select("state", F.explode(F.from_json("geojson", "features array<struct<c_custkey:long>>")["features"]).alias("f"))
    return kept.groupBy("state").agg(F.count(F.lit(1)).alias("features"), F.min("f.c_custkey").alias("first_key"))


@query(
    "q29_hierarchy_rollup",
    f"WITH {_SA2} SELECT state_name, sa4_name, sa3_name, CAST(grouping_id(state_name, sa4_name, sa3_name) AS BIGINT) AS level_id, {_INDICATORS} FROM sa2 GROUP BY ROLLUP (state_name, sa4_name, sa3_name)",
)
def hierarchy_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Extension: every level of the hierarchy at once."""
    return areas.rollup(sa2(spark, d)).select("state_name", "sa4_name", "sa3_name", "level_id", *SHOWN)


@query("q30_window_summary", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_summary(spark: SparkSession, d: str) -> DataFrame:
    """Extension: the streaming summary, run over the events as a batch."""
    return alerts.window_summary(t(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "q31_apportion",
    "SELECT CAST(o_custkey % 5 + k AS VARCHAR) AS LGA_CODE_2025, CAST(sum(CAST(o_orderkey % 1000 AS DOUBLE) * CASE k WHEN 0 THEN 0.75 ELSE 0.25 END) AS DOUBLE) AS amount FROM orders, (SELECT unnest([0, 1]) AS k) WHERE o_custkey % 7 < 5 GROUP BY 1",
)
def apportion(spark: SparkSession, d: str) -> DataFrame:
    """Extension: values of old areas shared out to new ones by ratios that are exact in binary."""
    code = F.col("o_custkey") % 7 * 10 + F.col("o_custkey") % 5
    values = t(spark, d, "orders").select(code.cast("string").alias("LGA_CODE_2024"), (F.col("o_orderkey") % 1000).cast("double").alias("amount"))
    shares = [(str(a * 10 + b), str(b + k), r) for a in range(5) for b in range(5) for k, r in ((0, "0.75"), (1, "0.25"))]
    table = spark.createDataFrame(shares, "LGA_CODE_2024 string, LGA_CODE_2025 string, RATIO_FROM_TO string")
    return etl.apportioned(values, table, "amount")


@query("q32_evidence_codes", "SELECT conv_id, code, contains(lower(text), lower(code)) AS used FROM (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id) CROSS JOIN (SELECT unnest(['O1', 'P2', 'R3', 'A4', 'U0']) AS code)")
def evidence_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes hold no blanks, so none straddles two turns: each turn is looked at by itself."""
    said = t(spark, d, "conversations").select("conv_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    each = said.select("conv_id", F.explode(F.array(*(F.struct(F.lit(e[0]).alias("code"), F.contains("low", F.lit(e[0].lower())).alias("used")) for e in fixed.EVIDENCE))).alias("x"))
    return each.groupBy("conv_id", "x.code").agg(F.bool_or("x.used").alias("used"))


@query("q33_setting_type", "SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 'campus' WHEN contains(lower(c_mktsegment), 'house') THEN 'community' ELSE 'general' END AS setting FROM customer")
def setting(spark: SparkSession, d: str) -> DataFrame:
    """Ordered CASE, first keyword group wins; segments stand for scenarios."""
    scenario = F.regexp_replace(F.regexp_replace(F.lower("c_mktsegment"), "build", "school"), "house", "community")
    return t(spark, d, "customer").select("c_custkey", matching.setting_type(scenario).alias("setting"))


_REQUEST = "SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN 'near ' || lower(n_name) WHEN 1 THEN r_name WHEN 2 THEN '' WHEN 3 THEN 'zzz' ELSE n_name END AS location FROM " + UNITS


def asked(spark: SparkSession, d: str) -> DataFrame:
    """customer as requests with a location: names of areas, parts of them, blank or unknown."""
    k = F.col("c_custkey") % 5
    said = F.when(k == 0, F.concat(F.lit("near "), F.lower("n_name"))).when(k == 1, F.col("r_name")).when(k == 2, "").when(k == 3, "zzz").otherwise(F.col("n_name"))
    return units(spark, d).select(F.col("c_custkey").alias("request_id"), said.alias("location"))


@query(
    "q34_enriched_features",
    """WITH p AS (SELECT s_nationkey AS k, max(s_suppkey) AS n FROM supplier GROUP BY ALL)
    SELECT CAST(n_nationkey AS VARCHAR) AS sa2_code_2021, coalesce(CAST(n AS VARCHAR), '') AS population, CASE n % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'unknown' END AS language_support_needed,
    CASE n % 3 WHEN 0 THEN '190,40,40,95' WHEN 1 THEN '60,140,90,70' ELSE '120,120,120,60' END AS colour FROM nation LEFT JOIN p ON k = n_nationkey""",
)
def enriched_features(spark: SparkSession, d: str) -> DataFrame:
    no = F.col("s_suppkey")
    profiles = t(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("sa2_code_2021"), no.cast("string").alias("population"), F.when(no % 3 == 0, "high").when(no % 3 == 1, "low").alias("language_support_needed"), no.alias("seq"))
    found = etl.enriched_features(t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("sa2_code_2021")), profiles)
    return found.select("sa2_code_2021", "population", "language_support_needed", F.array_join(F.transform("fill_color", lambda x: x.cast("string")), ",").alias("colour"))


@query(
    "q35_mapped_features",
    "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 3 THEN 'Unmapped' WHEN 2 THEN 'third' WHEN 1 THEN 'second' ELSE 'third' END AS mapped_location FROM nation",
)
def mapped_features(spark: SparkSession, d: str) -> DataFrame:
    """Units in configured regions; of several regions the last counts."""
    names = t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("sa2_name"))
    in_region = lambda name, no, keep: names.filter(keep).groupBy().agg(F.collect_list("sa2_name").alias("sa2_names")).select(F.lit(name).alias("location"), F.lit(no).cast("long").alias("seq"), "sa2_names")
    regions = in_region("first", 0, F.col("n_nationkey") % 4 == 0).unionByName(in_region("second", 1, F.col("n_nationkey") % 4 == 1)).unionByName(in_region("third", 2, F.col("n_nationkey") % 2 == 0).withColumn("sa2_names", F.col("sa2_names")))
    return etl.mapped_features(names, regions).select("n_nationkey", "mapped_location")


@query(
    "q36_first_area",
    f"""WITH r AS ({_REQUEST}), a AS (SELECT 1 AS rank, r_name AS name, r_regionkey AS o FROM region UNION ALL SELECT 2, n_name, n_nationkey FROM nation),
    m AS (SELECT request_id, arg_min(name, rank * 1000 + o) AS area_name, min(rank) AS rank FROM r JOIN a ON location <> '' AND (contains(lower(location), lower(name)) OR contains(lower(name), lower(location))) GROUP BY request_id)
    SELECT request_id, CASE rank WHEN 1 THEN 'SA4' ELSE 'SA3' END AS level, area_name FROM m""",
)
def first_area(spark: SparkSession, d: str) -> DataFrame:
    table = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    named = table.select(F.col("r_name").alias("sa4_name"), F.col("n_name").alias("sa3_name"), F.lit("").alias("sa2_name"), F.lit("any").alias("state_name"), F.col("n_nationkey").cast("long").alias("seq"))
    return areas.first_area(asked(spark, d), named).select("request_id", "level", "area_name")


@query(
    "q37_first_location",
    f"WITH r AS ({_REQUEST}) SELECT request_id, arg_min(n_name, n_nationkey) AS matched FROM r JOIN nation ON location <> '' AND (contains(lower(location), lower(n_name)) OR contains(lower(n_name), lower(location))) GROUP BY request_id",
)
def first_location(spark: SparkSession, d: str) -> DataFrame:
    profiles = t(spark, d, "nation").select(F.col("n_name").alias("location"), F.col("n_nationkey").cast("long").alias("seq"))
    return areas.first_location(asked(spark, d), profiles)


@query(
    "q38_allocation_summary",
    f"""SELECT n_name AS selected_area, count(*) AS sa2_count, string_agg(DISTINCT r_name, ', ') AS sa4_names, sum(c_custkey)::DOUBLE AS area_albers_sqkm FROM {UNITS} GROUP BY n_name""",
)
def allocation_summary(spark: SparkSession, d: str) -> DataFrame:
    table = units(spark, d).select(
        F.lit("any").alias("state_name_2021"), F.col("c_name").alias("sa2_name_2021"), F.col("n_name").alias("sa3_name_2021"), F.col("r_name").alias("sa4_name_2021"), F.lit("g").alias("gccsa_name_2021"),
        F.col("c_custkey").cast("string").alias("area_albers_sqkm"), F.col("c_custkey").alias("seq"),
    )
    names = t(spark, d, "nation").select(F.col("n_nationkey").alias("request_id"), F.struct(F.lit("SA3").alias("level"), F.col("n_name").alias("area_name"), F.lit(None).cast("string").alias("state")).alias("area_selection"))
    return areas.allocation_summary(names, table).select("selected_area", "sa2_count", "sa4_names", "area_albers_sqkm")


RULES = [("asia", ["asia"], []), ("nation", ["nation_1", "nation_2"], ["machinery"]), ("build", [], ["build", "house"]), ("never", ["qqq"], [])]
_RULE_SQL = " UNION ALL ".join(f"SELECT {i} AS seq, {q(k)} AS id, CAST({a} AS VARCHAR[]) AS places, CAST({b} AS VARCHAR[]) AS plans" for i, (k, a, b) in enumerate(RULES))


@query(
    "q39_matched_rules",
    f"""WITH rules AS ({_RULE_SQL}), r AS (SELECT request_id, lower(location) AS place, lower(c_mktsegment) AS plan FROM ({_REQUEST}) JOIN customer ON request_id = c_custkey),
    m AS (SELECT request_id, string_agg(id, ',' ORDER BY seq) AS ids FROM r JOIN rules ON len(list_filter(places, lambda x: contains(place, x))) > 0 OR len(list_filter(plans, lambda x: contains(plan, x))) > 0 GROUP BY request_id)
    SELECT request_id, coalesce(ids, '') AS ids FROM r LEFT JOIN m USING (request_id)""",
)
def matched_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(k, (a, b), [f"{k} point"], [], i) for i, (k, a, b) in enumerate(RULES)], schemas.DDL["rules"] + ", seq long")
    requests = asked(spark, d).join(t(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.col("c_mktsegment").alias("scenario")), "request_id")
    return matching.risk_context(requests, rules).select("request_id", F.array_join("matched_rule_ids", ",").alias("ids"))


@query(
    "q40_community_match",
    f"""WITH r AS (SELECT request_id, lower(location) AS said, CASE WHEN c_mktsegment = 'BUILDING' THEN r_name END AS region FROM ({_REQUEST}) x JOIN ({UNITS}) ON request_id = c_custkey),
    c AS (SELECT n_nationkey AS seq, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0), s AS (SELECT r_name, min(seq) AS seq, arg_min(n_name, seq) AS n_name FROM c GROUP BY ALL),
    m AS (SELECT request_id, 1 AS tier, seq, n_name FROM r JOIN c ON said <> '' AND (contains(said, lower(n_name)) OR contains(lower(n_name), said)) UNION ALL SELECT request_id, 2, seq, n_name FROM r JOIN s ON region = r_name)
    SELECT request_id, arg_min(n_name, tier * 1000 + seq) AS location FROM m GROUP BY request_id""".replace(f"({UNITS})", f"(SELECT c_custkey, c_mktsegment, r_name FROM {UNITS})"),
)
def community_match(spark: SparkSession, d: str) -> DataFrame:
    """By name first, then the state's first row where the scenario is remote."""
    more = units(spark, d).select(F.col("c_custkey").alias("request_id"), F.col("r_name").alias("state"), F.when(F.col("c_mktsegment") == "BUILDING", "remote town").otherwise("").alias("scenario"))
    rows = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey % 3 = 0")
    rows = rows.select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("location"), F.col("r_name").alias("state"))
    return matching.community_matches(asked(spark, d).join(more, "request_id"), rows).select("request_id", "location")


@query(
    "q41_lga_candidates",
    f"""WITH r AS (SELECT c_custkey AS request_id, r_name, lower(n_name) AS term FROM {UNITS}), h AS (SELECT request_id, n_nationkey, row_number() OVER (PARTITION BY request_id ORDER BY n_nationkey) AS k
    FROM r JOIN nation ON contains(lower(n_name), term) OR contains(term, lower(n_name)) JOIN region ON n_regionkey = r_regionkey AND region.r_name = r.r_name)
    SELECT request_id, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS codes FROM h WHERE k <= 5 GROUP BY request_id""",
)
def lga_candidates(spark: SparkSession, d: str) -> DataFrame:
    profiles = units(spark, d).select(F.col("c_custkey").alias("request_id"), F.col("r_name").alias("state"), F.concat(F.lit("of, "), "n_name").alias("location"))
    table = t(spark, d, "nation").join(F.broadcast(t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("seq"), F.col("n_nationkey").cast("string").alias("lga_code_2025"), F.col("n_name").alias("lga_name_2025"), F.col("r_name").alias("state_name_2021"), F.lit("1").alias("mesh_block_count"), F.lit("1").alias("area_albers_sqkm")
    )
    found = matching.lga_candidates(profiles, table)
    return found.select("request_id", F.array_join(F.transform("lga_candidates", lambda x: x["lga_code_2025"]), ",").alias("codes"))


@query(
    "q42_row_counts",
    "SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
)
def row_counts(spark: SparkSession, d: str) -> DataFrame:
    return etl.row_counts({k: t(spark, d, k) for k in ("customer", "orders", "lineitem")})


@query(
    "q43_governed",
    f"WITH {_REPORTS} SELECT conv_id, {q(fixed.NOTICE)} || chr(10) || chr(10) || trim(text, ' ' || chr(10)) AS governed FROM reports",
)
def governed(spark: SparkSession, d: str) -> DataFrame:
    """The canonical notice before each report; a second call changes nothing."""
    return reports(spark, d).select("conv_id", text.governed(text.governed(F.col("text"))).alias("governed"))


@query(
    "q44_signoff",
    f"WITH {_REPORTS} SELECT conv_id, (length(text) - length(replace(text, '## ', ''))) // 3 + CASE WHEN contains(text, {q(fixed.SIGNOFF_HEADING)}) THEN 0 ELSE 1 END AS headings FROM reports",
)
def signoff(spark: SparkSession, d: str) -> DataFrame:
    """A sign-off section once, in place of an earlier one, however often it is put in."""
    record = {"approval_status": F.lit("Draft")}
    twice = text.with_signoff(text.with_signoff(F.col("text"), record), record)
    return reports(spark, d).select("conv_id", ((F.length(twice) - F.length(F.replace(twice, F.lit("## ")))) / 3).cast("long").alias("headings"))


@query(
    "q45_widest_table",
    f"""WITH {_REPORTS}, l AS (SELECT conv_id, trim(unnest(string_split(text, chr(10)))) AS line FROM reports) SELECT conv_id, max(length(line) - length(replace(line, '|', '')) - 1)::BIGINT AS cells FROM l WHERE line LIKE '|%|' GROUP BY conv_id""",
)
def widest_table(spark: SparkSession, d: str) -> DataFrame:
    found = text.blocks(reports(spark, d), "conv_id").filter("kind = 'table'")
    return found.select("conv_id", text.table_width(F.col("lines")).alias("cells")).groupBy("conv_id").agg(F.max("cells").cast("long").alias("cells"))


@query("q46_report_meta", f"WITH {_REPORTS} SELECT conv_id, CASE WHEN starts_with(text, '# Plan') THEN 'Plan' ELSE regexp_extract(text, '^#+ ([^' || chr(10) || ']+)', 1) END AS title, 'To be confirmed' AS location FROM reports".replace("'To be confirmed'", q(fixed.UNKNOWN)))
def report_meta(spark: SparkSession, d: str) -> DataFrame:
    return text.report_meta(reports(spark, d), "conv_id").select("conv_id", "title", "location")


@query(
    "q47_elapsed",
    "SELECT user_id, max((epoch_us(ts) - epoch_us(before)) // 1000)::BIGINT AS longest FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id",
)
def elapsed(spark: SparkSession, d: str) -> DataFrame:
    """The longest time between two events of a user, in milliseconds."""
    events = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select("user_id", elapsed_ms(before, F.col("ts")).alias("ms")).groupBy("user_id").agg(F.max("ms").alias("longest"))


# Reports made of what was said in conversations: letters and stops of each message, under their turn and role.
_SAID = """said AS (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS report_id, turn, coalesce(nullif(role, ''), 'nobody') AS role, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z.]+', ' ', 'g')) AS body FROM conversations)"""
_LF = "chr(10)"


def said(spark: SparkSession, d: str) -> DataFrame:
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z.]+", " "))
    return t(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("report_id"), "turn", F.coalesce(F.nullif("role", F.lit("")), F.lit("nobody")).alias("role"), body.alias("body"))


@query(
    "q49_said_meta",
    f"WITH {_SAID} SELECT report_id, 'Reply ' || CAST(turn AS VARCHAR) AS title, coalesce(nullif(trim(left(body, 15)), ''), 'Nowhere') AS location, role AS audience FROM said",
)
def said_meta(spark: SparkSession, d: str) -> DataFrame:
    """Title, place and audience of every message as a report; the last named place counts."""
    parts = ["# Reply ", F.col("turn"), "\n\nLocation: Nowhere\n- Audience of old\nAUDIENCE: ", F.col("role"), "\n\n", F.col("body"), "\n\n**Location:** ", F.left("body", F.lit(15))]
    rows = said(spark, d).select("report_id", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("text"))
    return text.report_meta(rows, "report_id").select("report_id", "title", "location", "audience")


@query(
    "q50_said_notice",
    f"""WITH {_SAID} SELECT report_id, {q(fixed.NOTICE)} || {_LF} || {_LF} || trim(CASE turn % 3 WHEN 1 THEN '# Part' || {_LF} || body ELSE body END, ' ' || {_LF}) AS governed FROM said""",
)
def said_notice(spark: SparkSession, d: str) -> DataFrame:
    """The canonical notice in place of altered ones, with a disclaimer or without."""
    mark, body = F.lit(fixed.NOTICE_MARK), F.col("body")
    altered = F.concat(mark, F.lit("\n\nOther words: "), F.left("body", F.lit(9)), F.lit(f"\n\n{fixed.DISCLAIMER_MARK} other words.\n\n"), body)
    cut = F.concat(mark, F.lit(" cut off\n# Part\n"), body)
    rows = said(spark, d).select("report_id", F.when(F.col("turn") % 3 == 0, altered).when(F.col("turn") % 3 == 1, cut).otherwise(body).alias("text"))
    return rows.select("report_id", text.governed(text.governed(F.col("text"))).alias("governed"))


_RAW = ["Call `plan_complete` function now\n", "body", " checklist_update(a, 1) has been called. Then\n```JSON {\n1}\n```", "\n\n\n\nSee https://x.y/z?a=b end `plan_complete` and Checklist_Complete()", "\n\n"]
_CLEANED = "(" + " || ".join("left(body, 40)" if p == "body" else f"replace({q(p.replace(chr(10), '~'))}, '~', chr(10))" for p in _RAW) + ")"
for _pattern, _to in fixed.MODEL_OUTPUT_PATTERNS:
    _CLEANED = f"regexp_replace({_CLEANED}, {q(_pattern)}, replace({q(_to.replace(chr(10), '~'))}, '~', chr(10)), 'g')"


@query("q51_said_cleaned", f"WITH {_SAID} SELECT report_id, trim({_CLEANED}, ' ' || {_LF}) AS cleaned FROM said")
def said_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Model output without calls, JSON and links: all patterns at once."""
    raw = F.concat(*(F.left("body", F.lit(40)) if p == "body" else F.lit(p) for p in _RAW))
    return said(spark, d).select("report_id", text.clean_model_output(raw).alias("cleaned"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp()
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "q52_published_collections",
    f"SELECT regexp_replace(r_name, '[^A-Za-z0-9]', '_', 'g') AS folder, c_name AS name, count(*) AS features FROM {UNITS} GROUP BY ALL",
)
def published_collections(spark: SparkSession, d: str) -> DataFrame:
    """Units as FeatureCollections by region, published by the write's commit and read back."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("c_name").alias("name")).alias("properties")))
    path = _scratch(spark, "collections")
    published.write_collections(units(spark, d).select(F.col("r_name").alias("state"), feature.alias("feature")), path, most=1000)
    read = published.read_collections(spark, path)
    return read.groupBy("folder", F.get_json_object("feature", "$.properties.name").alias("name")).agg(F.count(F.lit(1)).alias("features"))
