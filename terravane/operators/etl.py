"""Geographic ETL: boundaries with profiles, configured regions, allocations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions.expr import count_of, palette, ratio_pct, rounded, support_band

#: Colours of support bands and of configured regions, and the cohort columns of older people.
BAND_COLOURS = {"high": [190, 40, 40, 95], "medium": [230, 145, 45, 85], "low": [60, 140, 90, 70], "unknown": [120, 120, 120, 60]}
REGION_COLOURS = [[220, 80, 60, 90], [70, 130, 180, 90], [80, 160, 90, 90], [150, 100, 180, 90]]
COHORTS = ["erp_p_152022", "erp_p_162022", "erp_p_172022", "erp_p_182022", "erp_p_192022"]


def last_per_key(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The last row of each key; a null key is none."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("x")).select(key, "x.*")


def sum_of(columns: Sequence[str]) -> Column:
    """Sum across columns, blanks as zero."""
    return sum((count_of(F.col(c)) for c in columns), F.lit(0).cast("long"))


def unit_profiles(boundaries: DataFrame, population: DataFrame, cohorts: Sequence[str] = COHORTS) -> DataFrame:
    """Boundary rows with the indicators of their unit code, blank where there is none; of duplicates the last counts."""
    right = last_per_key(population, "sa2_code_2021").withColumns({"n": count_of(F.col("erp_p_202022")), "older": sum_of(cohorts), "language": count_of(F.col("census_392021"))})
    joined = boundaries.join(right.select("sa2_code_2021", "n", "older", "language"), "sa2_code_2021", "left")
    language = ratio_pct(F.col("language"), F.col("n"))
    return joined.select(
        *boundaries.columns, F.nullif("n", F.lit(0)).alias("population"), F.nullif("older", F.lit(0)).alias("older_people_count"), ratio_pct(F.col("older"), F.col("n")).alias("older_people_pct"),
        F.nullif("language", F.lit(0)).alias("language_other_than_english_count"), language.alias("language_other_than_english_pct"),
        support_band(language, F.col("n")).alias("language_support_needed"),
    )


def band_colour(band: Column) -> Column:
    colour = F.array(*map(F.lit, BAND_COLOURS["unknown"]))
    for name, c in BAND_COLOURS.items():
        colour = F.when(band == name, F.array(*map(F.lit, c))).otherwise(colour)
    return colour


def enriched_features(features: DataFrame, profiles: DataFrame) -> DataFrame:
    """Feature rows (sa2_code_2021 and more) with population, band and colour of their profile."""
    slim = last_per_key(profiles.select("sa2_code_2021", "population", "language_support_needed", "seq"), "sa2_code_2021")
    joined = features.join(slim.drop("seq"), "sa2_code_2021", "left")
    band = F.coalesce("language_support_needed", F.lit("unknown"))
    return joined.withColumns({"population": F.coalesce(F.col("population").cast("string"), F.lit("")), "language_support_needed": band, "fill_color": band_colour(band)})


def region_names(regions: DataFrame) -> DataFrame:
    """location, region_no and each of its unit names, once."""
    return regions.select("location", F.col("seq").alias("region_no"), F.explode(F.array_distinct("sa2_names")).alias("sa2_name"))


def mapped_features(features: DataFrame, regions: DataFrame) -> DataFrame:
    """Feature rows (sa2_name) with their region, "Unmapped" without one, and its colour; of several regions the last counts."""
    names = region_names(regions).groupBy("sa2_name").agg(F.max_by("location", "region_no").alias("location"), F.max("region_no").alias("region_no"))
    joined = features.join(names, "sa2_name", "left")
    return joined.select(*features.columns, F.coalesce("location", F.lit("Unmapped")).alias("mapped_location"), palette(F.coalesce("region_no", F.lit(0)), REGION_COLOURS).alias("fill_color"))


def region_profiles(regions: DataFrame, units: DataFrame) -> DataFrame:
    """One row per region, also without a matching unit: ratios of sums, sorted unit names."""
    joined = region_names(regions).join(units, "sa2_name", "left")
    sums = joined.groupBy("location").agg(
        *(F.coalesce(F.sum(count_of(F.col(c))), F.lit(0)).alias(a) for c, a in (("population", "population"), ("older_people_count", "older"), ("language_other_than_english_count", "language"))),
        F.count("population").alias("matched_sa2_count"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("population").isNotNull(), F.col("sa2_name")))), "; ").alias("matched_sa2_names"),
    )
    language = ratio_pct(F.col("language"), F.col("population"))
    kept = regions.select("location", "state", "geography_type", "match_method", F.col("notes").alias("mapping_notes"))
    return kept.join(sums, "location", "left").select(
        "location", "state", F.coalesce("population", F.lit(0)).alias("population"), ratio_pct(F.col("older"), F.col("population")).alias("older_people_pct"), language.alias("language_other_than_english_pct"),
        support_band(language, F.col("population")).alias("language_support_needed"), F.coalesce("matched_sa2_count", F.lit(0)).alias("matched_sa2_count"),
        F.coalesce("matched_sa2_names", F.lit("")).alias("matched_sa2_names"), "geography_type", "match_method", "mapping_notes",
    )


def lga_summary(allocation: DataFrame) -> DataFrame:
    """Mesh-block rows by area code: first name and state, count, area; blank codes go, unreadable areas count zero."""
    coded = allocation.filter("lga_code_2025 <> ''")
    grouped = coded.groupBy("lga_code_2025").agg(
        *(F.min_by(c, "seq").alias(c) for c in ("lga_name_2025", "state_code_2021", "state_name_2021")),
        F.count(F.lit(1)).alias("mesh_block_count"), rounded(F.coalesce(F.sum(F.col("area_albers_sqkm").try_cast("double")), F.lit(0.0)), 4).alias("area_albers_sqkm"),
    )
    return grouped.orderBy("state_name_2021", "lga_name_2025", "lga_code_2025")


def without_blank_rows(rows: DataFrame) -> DataFrame:
    """Rows with text in any column but seq."""
    return rows.filter(F.exists(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if c != "seq")), lambda x: x != ""))


def apportioned(values: DataFrame, correspondence: DataFrame, value: str) -> DataFrame:
    """Extension: values of 2024 areas shared out to 2025 areas by their ratios."""
    ratio = F.col("RATIO_FROM_TO").cast("double")
    return values.join(correspondence, "LGA_CODE_2024").groupBy("LGA_CODE_2025").agg(F.sum(F.col(value) * ratio).alias(value))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
