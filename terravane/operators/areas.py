"""Statistical areas: filters by level, roll-ups, lookups and map centres.

The hierarchy is state, SA4, SA3, SA2; rows are SA2 units. Tables keep their order in seq, which decides first
matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravane import fixed, schemas
from terravane.functions.expr import blank_to, count_of, file_slug, number_of, ratio_pct, rounded, support_band
from terravane.operators.containing import overlapping


def level_column(level: str, strict: bool = False, suffix: str = "") -> str | None:
    """The name column of a level; an unknown level is SA4, or None if strict."""
    name = fixed.LEVEL_COLUMNS.get(level, None if strict else "sa4_name")
    return name and name + suffix


def in_area(units: DataFrame, level: str, area: str, state: str | None = None, strict: bool = False) -> DataFrame:
    """Units of an area; a state narrows it, as names repeat between states."""
    column = level_column(level, strict)
    if column is None:
        return units.limit(0)
    found = units.filter(F.col(column) == area)
    return found.filter(F.col("state_name") == state) if state else found


def _sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("sa2_count"),
        *(F.coalesce(F.sum(count_of(F.col(c))), F.lit(0)).alias(a) for c, a in (("population", "population"), ("older_people_count", "older"), ("language_other_than_english_count", "language"))),
    ]


def _indicators(sums: DataFrame, *keep: str) -> DataFrame:
    language = ratio_pct(F.col("language"), F.col("population"))
    return sums.select(
        *keep, "sa2_count", "population", ratio_pct(F.col("older"), F.col("population")).alias("older_people_pct"),
        language.alias("language_other_than_english_pct"), support_band(language, F.col("population")).alias("language_support_needed"),
    )


def area_profile(units: DataFrame, level: str, area: str, state: str | None = None) -> DataFrame:
    """One row of indicators, also where no unit matches: percentages are ratios of sums."""
    sums = in_area(units, level, area, state).agg(*_sums())
    return _indicators(sums.withColumns({"selected_level": F.lit(level), "selected_area": F.lit(area)}), "selected_level", "selected_area")


def matched_area_profile(units: DataFrame, level: str, area: str, state: str | None = None) -> DataFrame:
    """The same, without a row where no unit matches or the level is unknown."""
    sums = in_area(units, level, area, state, strict=True).agg(*_sums()).filter("sa2_count > 0")
    return _indicators(sums.withColumns({"selected_level": F.lit(level), "selected_area": F.lit(area)}), "selected_level", "selected_area")


def selections(units: DataFrame) -> DataFrame:
    """Each unit once for every selection that can hold it: level, area_name and state, the state also null for any (once, for a unit without state)."""
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.col(c).alias("area_name")) for k, c in fixed.LEVEL_COLUMNS.items()))
    flat = units.withColumn("x", F.explode(levels)).select("*", "x.*").drop("x").filter("area_name <> ''")
    return flat.withColumn("state", F.explode(F.array_distinct(F.array(F.col("state_name"), F.lit(None)))))


def selected_profiles(requests: DataFrame, units: DataFrame) -> DataFrame:
    """request_id and indicators of every request's selected area, in one aggregate; no row without a match."""
    wanted = requests.select("request_id", "area_selection.level", "area_selection.area_name", F.nullif("area_selection.state", F.lit("")).alias("state")).filter("level is not null and area_name <> ''")
    areas = selections(units).groupBy("level", "area_name", "state").agg(*_sums())
    joined = wanted.join(areas.withColumnRenamed("state", "area_state"), ["level", "area_name"]).filter(F.col("state").eqNullSafe(F.col("area_state")))
    return _indicators(joined, "request_id", "level", "area_name", "state")


def allocation_summary(requests: DataFrame, allocation: DataFrame) -> DataFrame:
    """request_id and the geography reference of every request's selected area: counts, names in order, area."""
    units = allocation.select(
        F.col("state_name_2021").alias("state_name"), *(F.col(f"{c}_2021").alias(c) for c in ("sa2_name", "sa3_name", "sa4_name", "gccsa_name")),
        number_of(F.col("area_albers_sqkm")).alias("km2"), "seq",
    )
    # One row per unit and its names before anything is multiplied; then each name of an area once, with its first place.
    own = ["state_name", "sa2_name", "sa3_name", "sa4_name", "gccsa_name"]
    flat = selections(units.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.sum("km2").alias("km2"), F.min("seq").alias("seq")))
    area = ["level", "area_name", "state"]
    named = flat.select(*area, "seq", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in own[2:]))).alias("x")).filter("x.name <> ''")
    once = named.groupBy(*area, "x.kind", "x.name").agg(F.min("seq").alias("seq"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("seq", "name")))), lambda x: x["name"]), ", ")
    names = once.groupBy(*area).agg(*(in_order(c).alias(f"{c}s") for c in own[2:]))
    sums = flat.groupBy(*area).agg(F.sum("n").alias("sa2_count"), rounded(F.sum("km2"), 2).alias("area_albers_sqkm"), F.min_by("state_name", "seq").alias("first_state"))
    same = [sums[c].eqNullSafe(names[c]) for c in area]
    none = lambda c: F.coalesce(names[c], F.lit("")).alias(c)
    areas = sums.join(names, same, "left").select(*(sums[c] for c in area), "sa2_count", *(none(f"{c}s") for c in own[2:]), "area_albers_sqkm", "first_state")
    wanted = requests.select("request_id", "area_selection.level", "area_selection.area_name", F.nullif("area_selection.state", F.lit("")).alias("wanted_state"))
    joined = wanted.join(areas, ["level", "area_name"]).filter(F.col("wanted_state").eqNullSafe(F.col("state")))
    return joined.select(
        "request_id", F.col("level").alias("selected_level"), F.col("area_name").alias("selected_area"), F.coalesce("wanted_state", "first_state").alias("state_name"),
        "sa2_count", "sa3_names", "sa4_names", "gccsa_names", "area_albers_sqkm",
    )


def rollup(units: DataFrame) -> DataFrame:
    """Extension: indicators at every level of the hierarchy at once."""
    sums = units.rollup("state_name", "sa4_name", "sa3_name").agg(*_sums(), F.grouping_id().alias("level_id"))
    return _indicators(sums, "state_name", "sa4_name", "sa3_name", "level_id")


def options(units: DataFrame, level: str, state: str | None = None, search: str | None = None) -> DataFrame:
    """Distinct, sorted names of a level that contain the search text in any case; blank names are dropped."""
    column = level_column(level)
    found = units.filter(F.col("state_name") == state) if state else units
    if search:
        found = found.filter(F.contains(F.lower(column), F.lit(search.lower())))
    return found.select(F.col(column).alias("area_name")).filter("area_name <> ''").distinct().orderBy("area_name")


def states(units: DataFrame) -> DataFrame:
    return units.select("state_name").filter("state_name <> ''").distinct().orderBy("state_name")


def configured_names(regions: DataFrame) -> DataFrame:
    """All distinct unit names of the configured regions, sorted."""
    return regions.select(F.explode("sa2_names").alias("sa2_name")).distinct().orderBy("sa2_name")


def at_location(rows: DataFrame, location: str | None, column: str = "location") -> DataFrame:
    """Rows of a location in any case; all rows without one."""
    return rows.filter(F.lower(column) == location.lower()) if location else rows


def first_area(requests: DataFrame, units: DataFrame) -> DataFrame:
    """request_id, level, area_name, state: the first area whose name contains the location or the reverse.

    SA4 goes before SA3 before SA2, then the order of the table; a blank location has none.
    """
    rank = F.map_from_arrays(F.array(*map(F.lit, ("SA4", "SA3", "SA2"))), F.array(*map(F.lit, (1, 2, 3))))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.col(c).alias("area_name")) for k, c in fixed.LEVEL_COLUMNS.items()))
    flat = units.select("seq", F.col("state_name").alias("state"), F.explode(levels).alias("x")).select("seq", "state", "x.*").filter("area_name <> ''")
    # One row per name: the first occurrence decides, so the table shrinks before it meets the requests.
    names = flat.groupBy("level", "area_name").agg(F.min("seq").alias("seq"), F.min_by("state", "seq").alias("state"))
    found = names.select(F.lower("area_name").alias("name"), F.struct(rank[F.col("level")].alias("rank"), "seq", "level", "area_name", "state").alias("x"))
    return _first_overlapping(requests, found).select("request_id", "x.level", "x.area_name", "x.state")


def first_location(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """request_id, matched: the first configured location that contains the request's or the reverse."""
    names = profiles.groupBy(F.col("location").alias("matched")).agg(F.min("seq").alias("seq"))
    found = names.select(F.lower("matched").alias("name"), F.struct("seq", "matched").alias("x"))
    return _first_overlapping(requests, found).select("request_id", "x.matched")


def _first_overlapping(requests: DataFrame, names: DataFrame) -> DataFrame:
    """request_id and the least x of the names (name, x) that contain the location or the reverse; each location is looked up once."""
    asked = requests.select("request_id", F.lower("location").alias("said")).filter("said <> ''")
    pairs = overlapping(asked.select(F.col("said").alias("text")).distinct(), names.select(F.col("name").alias("text")).distinct())
    best = pairs.join(names, F.col("other") == F.col("name")).groupBy("one").agg(F.min("x").alias("x"))
    return asked.join(best, F.col("said") == F.col("one")).groupBy("request_id").agg(F.min("x").alias("x"))


def features_in(collection: DataFrame, level: str, area: str, state: str | None = None) -> DataFrame:
    """The collection with the features of an area only."""
    name = level_column(level, suffix="_2021")

    def keep(f: Column) -> Column:
        p = f["properties"]
        fits = F.coalesce(p[name] == area, F.lit(False))
        return fits & F.coalesce(p["state_name_2021"] == state, F.lit(False)) if state else fits

    return collection.withColumn("features", F.filter("features", keep))


def features_at(collection: DataFrame, location: str | None) -> DataFrame:
    """The collection with the features mapped to a location; all without one."""
    if not location:
        return collection
    return collection.withColumn("features", F.filter("features", lambda f: F.coalesce(F.lower(f["properties"]["mapped_location"]) == location.lower(), F.lit(False))))


def vertices(geometry: Column) -> Column:
    """All points with two coordinates at least of a polygon or multi-polygon."""
    polygon = F.flatten(F.from_json(geometry["coordinates"], schemas.POLYGON))
    multi = F.flatten(F.flatten(F.from_json(geometry["coordinates"], schemas.MULTI_POLYGON)))
    points = F.when(geometry["type"] == "Polygon", polygon).when(geometry["type"] == "MultiPolygon", multi)
    return F.filter(F.coalesce(points, F.array().cast("array<array<double>>")), lambda p: F.size(p) >= 2)


def centre(collection: DataFrame) -> DataFrame:
    """longitude, latitude: mean of all vertices, or the default centre."""
    points = collection.select(F.explode("features").alias("f")).select(F.explode(vertices(F.col("f.geometry"))).alias("p"))
    return points.agg(F.coalesce(F.avg(F.col("p")[0]), F.lit(fixed.MAP_CENTRE[0])).alias("longitude"), F.coalesce(F.avg(F.col("p")[1]), F.lit(fixed.MAP_CENTRE[1])).alias("latitude"))


def coverage_table(profiles: DataFrame) -> DataFrame:
    """The display columns of the community profiles, blank where missing."""
    # The columns of the display.
    shown = ("location", "state", "population", "older_people_pct", "language_support_needed", "language_other_than_english_pct", "matched_sa2_count", "geography_type")
    return profiles.select(*(F.coalesce(c, F.lit("")).alias(c) for c in shown))


def boundary_file(state: Column) -> Column:
    return F.concat(file_slug(blank_to(state, "Unknown")), F.lit(".geojson"))


def latest_first(rows: DataFrame, by: str, top: int) -> DataFrame:
    """The last rows in an order."""
    return rows.orderBy(F.desc(by)).limit(top)


def first_per(rows: DataFrame, key: str, n: int, order: str = "seq") -> DataFrame:
    """The first n rows of each key."""
    own = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__n", own).filter(F.col("__n") <= n).drop("__n")
