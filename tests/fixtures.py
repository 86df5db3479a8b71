"""Registers and requests in the shape of the real ones, small enough to check by hand."""

from __future__ import annotations

from terravane import schemas


def rows(spark, schema, dicts):
    names = [f.name for f in schema]
    return spark.createDataFrame([(*(d.get(n) for n in names), k) for k, d in enumerate(dicts)], schema.simpleString()[7:-1].replace(":", " ") + ", seq long") if dicts else None


def typed(spark, ddl, tuples):
    return spark.createDataFrame([(*t, k) for k, t in enumerate(tuples)], ddl + ", seq long")


def unit(state, sa4, sa3, sa2, code, population, older, language):
    return {"state_name": state, "sa4_name": sa4, "sa3_name": sa3, "sa2_name": sa2, "sa2_code": code, "population": population, "older_people_count": older, "language_other_than_english_count": language}


UNITS = [
    unit("Queensland", "Cairns", "Cairns - South", "Edmonton", "1", "1000", "160", "200"),
    unit("Queensland", "Cairns", "Cairns - South", "Gordonvale", "2", "500.7", "40", ""),
    unit("Queensland", "Townsville", "Townsville", "Aitkenvale", "3", "", None, "5"),
    unit("New South Wales", "Riverina", "Wagga Wagga", "Central", "4", "800", "80", "64"),
    unit("Victoria", "Hume", "Wodonga", "Central", "5", "0", "0", "0"),
]
ALLOCATION = [
    {"sa2_code_2021": str(k), "sa2_name_2021": u["sa2_name"], "sa3_name_2021": u["sa3_name"], "sa4_name_2021": u["sa4_name"], "gccsa_name_2021": "Rest of " + u["state_name"], "state_name_2021": u["state_name"], "area_albers_sqkm": a}
    for k, (u, a) in enumerate(zip(UNITS, ("10.123", "x", "5", "7.005", "")))
]
COMMUNITY = [
    {"location": "Cairns", "state": "Queensland", "population": "1500", "older_people_pct": "16.3", "no_car_households_pct": None, "language_support_needed": "medium", "matched_sa2_count": "2", "matched_sa2_names": "A; B", "mapping_notes": "note", "source": "ABS", "source_years": "2021", "risk_notes": "Risk."},
    {"location": "Mildura", "state": "Victoria", "older_people_pct": "17", "no_car_households_pct": "9", "language_support_needed": "low", "risk_notes": "Dry."},
]
RULES = [
    ("cairns", (["cairns"], []), ["Cyclones.", "Heat."], ["Assume roads."]),
    ("wa_general", (["wa"], []), ["Western."], []),
    ("campus", ([], ["campus", "school"]), ["Heat.", "Classes."], ["Assume roads.", "Assume classes."]),
]
SOURCES = [("bom", "Bureau", "http://bom", ["australia"], "warnings", "daily"), ("qfes", "Fire", "http://q", ["queensland", "qld"], "fires", "daily"), ("rfs", "RFS", None, ["nsw"], "fires", "daily"), ("council", "Council", "http://c", ["cairns"], "local", "weekly")]
REGIONS = [("Cairns", "Queensland", "SA2", None, "name", "n", ["Edmonton", "Gordonvale", "Edmonton"]), ("Mildura", "Victoria", "SA2", None, "name", "n", ["Nowhere"])]
LGA = [
    {"lga_code_2025": c, "lga_name_2025": n, "state_name_2021": s, "mesh_block_count": "1", "area_albers_sqkm": "2.5"}
    for c, n, s in (("1", "Cairns", "Queensland"), ("2", "Cairns North", "Queensland"), ("3", "Perth", "Western Australia"), ("4", "Wagga Wagga", "New South Wales"), *((str(k), f"Cairns {k}", "Queensland") for k in range(5, 10)))
]
REQUESTS = [
    (1, " Cairns ", "Teachers", "School campus", ["Evacuation", "None such", "Evacuation"], "1 week", "", None),
    (2, "Wagga Wagga", "All", "Residents", None, "1 week", None, ("New South Wales", "SA3", "Wagga Wagga")),
    (3, "Perth Hills WA", "All", "remote community", [], "", "", ("", "SA4", "Nowhere")),
    (4, "", "", "", [], "", "", None),
    (5, "Somewhere Victoria", "x", "remote aged care", ["First aid training"], "", "", ("Queensland", "SA4", "Cairns")),
]


def tables(spark):
    d = schemas.DDL
    return {
        "units": rows(spark, schemas.SA2_PROFILES, UNITS), "allocation": rows(spark, schemas.SA2_ALLOCATION, ALLOCATION), "community": rows(spark, schemas.COMMUNITY_PROFILES, COMMUNITY),
        "lga": rows(spark, schemas.LGA_SUMMARY, LGA), "rules": typed(spark, d["rules"], RULES), "sources": typed(spark, d["sources"], SOURCES), "regions": typed(spark, d["regions"], REGIONS),
    }


def requests(spark):
    return spark.createDataFrame(REQUESTS, schemas.DDL["requests"])
