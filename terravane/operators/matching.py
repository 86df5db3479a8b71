"""Requests against registers: rules by keyword, sources by tag, places by name.

All operators work on a table of requests at once and keep the order of the registers (seq).
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane import fixed
from terravane.functions.expr import blank_to, ordered_distinct
from terravane.operators.areas import first_per
from terravane.operators.containing import overlapping
from terravane.operators.keywords import MOST, owners_found, short_ones


def in_order(value: str, seq: str = "seq") -> Column:
    """Aggregate: the values of a group as a list in the order of seq."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("o"), F.col(value).alias("v")))), lambda x: x["v"])


def matched_rules(requests: DataFrame, rules: DataFrame, mode: str = "substring", most: int = MOST) -> DataFrame:
    """Request and rule pairs: any location keyword in the location or any scenario keyword in the scenario.

    mode "substring" takes keywords anywhere; "boundary" wants short ones to stand alone. seq tells rules apart.
    """
    asked = requests.select("request_id", F.lower(F.coalesce("location", F.lit(""))).alias("place"), F.lower(F.coalesce("scenario", F.lit(""))).alias("plan"))
    lists = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"match.{k}").alias("keys")) for c, k in (("place", "location_keywords"), ("plan", "scenario_keywords"))))
    keys = rules.select(F.col("seq").cast("long").alias("owner"), F.explode(lists).alias("x")).select("owner", "x.field", F.explode(F.transform("x.keys", F.lower)).alias("keyword"))
    found = owners_found(asked, keys.withColumn("alone", short_ones(F.col("keyword"), mode)), most=most)
    return found.select("request_id", "owner").join(rules, F.col("owner") == F.col("seq")).drop("owner")


def risk_context(requests: DataFrame, rules: DataFrame, mode: str = "substring") -> DataFrame:
    """request_id, matched_rule_ids, risk_points, assumptions: in order, without repeats; a default where no rule matches."""
    found = matched_rules(requests, rules, mode).groupBy("request_id").agg(
        in_order("id").alias("ids"), F.flatten(in_order("risk_points")).alias("points"), F.flatten(in_order("assumptions")).alias("assumed")
    )
    joined = requests.select("request_id").join(found, "request_id", "left")
    none = F.coalesce(F.size("points"), F.lit(0)) <= 0
    empty = F.array().cast("array<string>")
    return joined.select(
        "request_id", F.coalesce("ids", empty).alias("matched_rule_ids"),
        F.when(none, F.array(F.lit(fixed.DEFAULT_RISK_POINT))).otherwise(ordered_distinct(F.col("points"))).alias("risk_points"),
        ordered_distinct(F.col("assumed"), F.when(none, F.array(F.lit(fixed.DEFAULT_ASSUMPTION)))).alias("assumptions"),
    )


def keyword_table(spark: SparkSession, regions: DataFrame | None = None) -> DataFrame:
    """tier, seq, keyword, state, locality: configured places, then state names, then cities."""
    rows = []
    for tier, table in ((2, fixed.STATE_KEYWORDS), (3, fixed.CITY_KEYWORDS)):
        rows += [(tier, k, w, s, None) for k, (s, w) in enumerate((s, w) for s, words in table.items() for w in words)]
    fixed_rows = spark.createDataFrame(rows, "tier int, seq long, keyword string, state string, locality string")
    if regions is None:
        return fixed_rows
    own = regions.select(F.lit(1).alias("tier"), "seq", F.lower("location").alias("keyword"), F.coalesce("state", F.lit(fixed.DEFAULT_STATE)).alias("state"), F.col("location").alias("locality"))
    return own.unionByName(fixed_rows)


def resolved_places(requests: DataFrame, keywords: DataFrame, most: int = MOST) -> DataFrame:
    """request_id, locality, state: of the first keyword by tier, then order; city and place names match anywhere."""
    asked = requests.select("request_id", F.lower("location").alias("said"), "location")
    # The tier goes before the order in one number.
    order = (F.col("tier").cast("long") * (1 << 40) + F.col("seq")).alias("owner")
    alone = (F.col("tier") == 2) & short_ones(F.col("keyword"), "boundary")
    first = owners_found(asked, keywords.select(F.lit("said").alias("field"), "keyword", alone.alias("alone"), order), first=True, most=most)
    places = keywords.groupBy(order).agg(F.min(F.struct("state", "locality")).alias("x"))
    known = first.groupBy("request_id").agg(F.min("owner").alias("owner")).join(places, "owner").select("request_id", "x")
    joined = asked.join(known, "request_id", "left")
    return joined.select("request_id", F.coalesce("x.locality", "location").alias("locality"), F.coalesce("x.state", F.lit(fixed.DEFAULT_STATE)).alias("state"))


def setting_type(scenario: Column) -> Column:
    """The first setting with a keyword in the scenario."""
    low, found = F.lower(scenario), F.lit("general")
    for name, words in reversed(fixed.SETTING_KEYWORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        found = F.when(hit, name).otherwise(found)
    return found


def tags(state: Column, locality: Column) -> Column:
    """Tags of a resolved place: national, state in full and short, locality."""
    short = F.create_map(*map(F.lit, chain.from_iterable(fixed.STATE_SHORT.items())))
    low = F.lower(state)
    known = (blank_to(state, "") != "") & (state != fixed.DEFAULT_STATE)
    own = F.when(known, F.array(F.replace(low, F.lit(" "), F.lit("_")), F.try_element_at(short, low)))
    return ordered_distinct(F.array(F.lit("australia")), own, F.array(F.lower(locality)))


def selected_sources(profiles: DataFrame, sources: DataFrame) -> DataFrame:
    """request_id, sources: those with a tag in common, in the order of the register; national ones always."""
    wanted = profiles.select("request_id", F.explode(tags(F.col("state"), F.col("locality"))).alias("tag"))
    tagged = sources.withColumn("tag", F.explode("scope"))
    # An equality join on tags, then one row per request and source.
    hit = wanted.join(tagged, "tag").groupBy("request_id", "seq").agg(F.first(F.struct(*sources.columns)).alias("s"))
    own = hit.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "s"))), lambda x: x["s"]).alias("sources"))
    kind = own.schema["sources"].dataType
    return profiles.select("request_id").join(own, "request_id", "left").select("request_id", F.coalesce("sources", F.array().cast(kind)).alias("sources"))


def community_matches(profiles: DataFrame, community: DataFrame) -> DataFrame:
    """request_id and the community row: name overlap in order first, then the state's first row for remote scenarios."""
    asked = profiles.select("request_id", F.lower("location").alias("said"), F.lower("state").alias("said_state"), F.lower("scenario").alias("plan"))
    rows = community.select("seq", F.lower("location").alias("name"), F.lower("state").alias("row_state"), F.struct(*community.columns).alias("row"))
    said = asked.select(F.col("said").alias("text")).filter("text <> ''").distinct()
    pairs = overlapping(said, rows.select(F.col("name").alias("text")).distinct())
    best = pairs.join(rows, F.col("other") == F.col("name")).groupBy("one").agg(F.min_by("row", "seq").alias("row"), F.min("seq").alias("seq"))
    near = asked.join(best, F.col("said") == F.col("one")).select("request_id", F.lit(1).alias("tier"), "seq", "row")
    by_state = rows.groupBy("row_state").agg(F.min_by("row", "seq").alias("row"), F.min("seq").alias("seq"))
    remote = asked.filter(F.contains("plan", F.lit("remote"))).join(by_state, F.col("said_state") == F.col("row_state")).select("request_id", F.lit(2).alias("tier"), "seq", "row")
    first = F.min_by("row", F.struct("tier", "seq")).alias("row")
    return near.unionByName(remote).groupBy("request_id").agg(first).select("request_id", "row.*")


def community_notes(compat: bool = True) -> Column:
    """Notes of a community row (columns older_people_pct and so on).

    compat: as the studied rules have it, one unreadable percentage silences both notes on percentages; else
    each stands for itself.
    """
    older, no_car = F.col("older_people_pct").try_cast("double"), F.col("no_car_households_pct").try_cast("double")
    both = older.isNotNull() & no_car.isNotNull() if compat else F.lit(True)
    blank = lambda c: blank_to(F.col(c), "") == ""
    return F.array_compact(F.array(
        F.coalesce("risk_notes", F.lit("")),
        F.when(both & (older >= fixed.OLDER_PEOPLE_LIMIT), fixed.NOTE_OLDER),
        F.when(both & (no_car >= fixed.NO_CAR_LIMIT), fixed.NOTE_NO_CAR),
        F.when(F.lower("language_support_needed").isin("medium", "high"), fixed.NOTE_LANGUAGE),
        F.when(blank("no_car_households_pct"), fixed.NOTE_TRANSPORT),
        F.when(~blank("matched_sa2_count") & ~blank("matched_sa2_names"), F.concat(F.lit("Configured SA2 mapping includes "), "matched_sa2_count", F.lit(" matched SA2 areas: "), "matched_sa2_names", F.lit("."))),
        F.when(~blank("mapping_notes"), F.col("mapping_notes")),
    ))


def location_terms(location: Column) -> Column:
    words = F.split(F.replace(F.lower(location), F.lit(","), F.lit(" ")), "(?U)\\s+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(fixed.LOCATION_STOP_WORDS))


def lga_candidates(profiles: DataFrame, lga: DataFrame, most: int = 5) -> DataFrame:
    """request_id, lga_candidates: the first local government areas of the state that share a term with the location.

    Terms and names meet in an equality join on the state and a group of letters; no more than the first areas of a
    request are gathered.
    """
    terms = profiles.select("request_id", F.lower("state").alias("s"), F.explode(F.array_distinct(location_terms(F.col("location")))).alias("term"))
    named = lga.withColumn("s", F.lower("state_name_2021")).withColumn("name", F.lower("lga_name_2025"))
    pairs = overlapping(terms.select("s", F.col("term").alias("text")).distinct(), named.select("s", F.col("name").alias("text")).distinct(), ["s"])
    hit = terms.join(pairs.select("s", F.col("one").alias("term"), F.col("other").alias("name")), ["s", "term"]).join(named, ["s", "name"])
    shown = F.struct("seq", *(F.col(c) for c in ("lga_code_2025", "lga_name_2025", "state_name_2021", "mesh_block_count", "area_albers_sqkm")), F.lit("lga_2025_summary.csv").alias("source_file"))
    first = first_per(hit.select("request_id", shown.alias("shown")).distinct(), "request_id", most, "shown")
    found = first.groupBy("request_id").agg(F.array_sort(F.collect_list("shown")).alias("x"))
    plain = found.select("request_id", F.transform("x", lambda x: x.dropFields("seq")).alias("lga_candidates"))
    kind = plain.schema["lga_candidates"].dataType
    return profiles.select("request_id").join(plain, "request_id", "left").select("request_id", F.coalesce("lga_candidates", F.array().cast(kind)).alias("lga_candidates"))


def planning_priorities(concerns: Column, setting: Column) -> Column:
    """General priorities, those of known concerns in their order, that of the setting; without repeats."""
    by_concern = F.create_map(*map(F.lit, chain.from_iterable(fixed.CONCERN_PRIORITIES.items())))
    by_setting = F.create_map(*map(F.lit, chain.from_iterable(fixed.SETTING_PRIORITIES.items())))
    known = F.transform(F.coalesce(concerns, F.array().cast("array<string>")), lambda c: F.try_element_at(by_concern, c))
    return ordered_distinct(F.array(*map(F.lit, fixed.PRIORITIES)), known, F.array(F.try_element_at(by_setting, setting)))


def evidence_rows(uses: dict[str, Column]) -> Column:
    """array<struct<code,evidence_class,confidence_boundary,required_review,current_use>>."""
    return F.array(*(
        F.struct(F.lit(code).alias("code"), F.lit(a).alias("evidence_class"), F.lit(b).alias("confidence_boundary"), F.lit(c).alias("required_review"), uses[code].alias("current_use"))
        for code, a, b, c in fixed.EVIDENCE
    ))


def by_name(requests: DataFrame, examples: DataFrame, key: str = "name") -> DataFrame:
    """Requests with the example or scenario that they name."""
    return requests.join(examples, key)
