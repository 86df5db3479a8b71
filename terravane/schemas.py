"""Explicit schemas: raw tables are read as strings, then cast; nested registers are typed at once."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, StringType, StructField, StructType, _parse_datatype_string


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


# The columns of the tables and registers that are read.
SA2_PROFILES = strings(
    "state_name", "state_code", "sa4_name", "sa4_code", "sa3_name", "sa3_code", "sa2_name", "sa2_code", "population", "older_people_count",
    "older_people_pct", "language_other_than_english_count", "language_other_than_english_pct", "language_support_needed", "source", "source_years",
)
COMMUNITY_PROFILES = strings(
    "location", "state", "population", "older_people_pct", "no_car_households_pct", "language_support_needed", "language_other_than_english_pct",
    "matched_sa2_count", "matched_sa2_names", "geography_type", "match_method", "mapping_notes", "source", "source_years", "risk_notes",
)
SA2_ALLOCATION = strings(
    "sa2_code_2021", "sa2_name_2021", "sa3_code_2021", "sa3_name_2021", "sa4_code_2021", "sa4_name_2021", "gccsa_code_2021", "gccsa_name_2021",
    "state_code_2021", "state_name_2021", "area_albers_sqkm", "asgs_loci_uri_2021",
)
LGA_ALLOCATION = strings("lga_code_2025", "lga_name_2025", "state_code_2021", "state_name_2021", "area_albers_sqkm")
LGA_SUMMARY = strings("lga_code_2025", "lga_name_2025", "state_code_2021", "state_name_2021", "mesh_block_count", "area_albers_sqkm")
LGA_CORRESPONDENCE = strings(
    "LGA_CODE_2024", "LGA_NAME_2024", "LGA_CODE_2025", "LGA_NAME_2025", "RATIO_FROM_TO", "INDIV_TO_REGION_QLTY_INDICATOR", "OVERALL_QUALITY_INDICATOR", "BMOS_NULL_FLAG",
)


def typed(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


_RULES = "id string, match struct<location_keywords:array<string>,scenario_keywords:array<string>>, risk_points array<string>, assumptions array<string>"
_SOURCES = "id string, name string, url string, scope array<string>, purpose string, use_when string"
_REGIONS = "location string, state string, geography_type string, lga_code string, match_method string, notes string, sa2_names array<string>"
_LICENCES = (
    "id string, source_name string, provider string, source_url string, licence_position string, commercial_position string, attribution_required string, "
    "caching_position string, exclusions_or_risks string, current_project_use string, review_status string"
)
_AREA = "struct<state:string,level:string,area_name:string>"
_REQUESTS = f"request_id long, location string, audience string, scenario string, concerns array<string>, timeframe string, extra_context string, area_selection {_AREA}"
_FEATURES = (
    "type string, features array<struct<type:string,properties:struct<sa2_code_2021:string,sa2_name_2021:string,sa3_name_2021:string,sa4_name_2021:string,"
    "state_name_2021:string,population:string,language_support_needed:string,mapped_location:string,fill_color:array<int>,line_color:array<int>>,"
    "geometry:struct<type:string,coordinates:string>>>"
)
#: Nested registers by name, as DDL; parsed in a session.
DDL = {"rules": _RULES, "sources": _SOURCES, "regions": _REGIONS, "licences": _LICENCES, "requests": _REQUESTS, "features": _FEATURES}
POLYGON, MULTI_POLYGON = "array<array<array<double>>>", "array<array<array<array<double>>>>"
NAMES = ArrayType(StringType())
