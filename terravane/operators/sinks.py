"""Sinks: CSV, JSON and GeoJSON by state, audit log, Markdown and packages."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from terravane.functions.expr import blank_to, file_slug


def observed(rows: DataFrame, **measures: Column) -> tuple[DataFrame, Observation]:
    """rows, and what is measured of them while they are written, without another scan: their number, unless other measures are given."""
    seen = Observation()
    wanted = measures or {"rows": F.count(F.lit(1))}
    return rows.observe(seen, *(c.alias(k) for k, c in wanted.items())), seen


def write_csv(rows: DataFrame, path: str, columns: Sequence[str], one_file: bool = False) -> int:
    """Fixed columns in order, header in each file; one_file is for registers, whose size is fixed. Returns the number of rows."""
    picked, seen = observed(rows.select(*columns))
    (picked.coalesce(1) if one_file else picked).write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)
    return seen.get["rows"]


def stamped(rows: DataFrame, **stamps: Column | str) -> DataFrame:
    """Rows with provenance columns."""
    return rows.withColumns({k: F.lit(v) if isinstance(v, str) else v for k, v in stamps.items()})


def in_parts(rows: DataFrame, key: str, most: int, *content: str) -> DataFrame:
    """rows with __part, so that the parts of a key hold about `most` rows each: as many parts as the key's rows need."""
    parts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).alias("__parts"))
    return rows.join(parts, key).withColumn("__part", F.pmod(F.xxhash64(*content), F.col("__parts"))).drop("__parts")


def write_features_by_state(features: DataFrame, path: str, state: str = "state_name_2021", most: int = 100_000) -> int:
    """One folder per state, "Unknown" without one, a JSON feature per line, `most` or so to a task; readers prune by state_slug.

    Returns the number of features.
    """
    keyed = features.withColumn("state_slug", file_slug(blank_to(F.col(state), "Unknown")))
    dealt = in_parts(keyed, "state_slug", most, *features.columns)
    placed, seen = observed(dealt.repartition("state_slug", "__part").drop("__part"))
    placed.write.mode("overwrite").partitionBy("state_slug").json(path)
    return seen.get["rows"]


def collections(features: DataFrame, feature: str, state: str = "state", most: int = 10_000) -> DataFrame:
    """state, part, geojson: FeatureCollections of about `most` features; a state with no more has part 0 alone."""
    named = features.select(F.coalesce(F.nullif(state, F.lit("")), F.lit("Unknown")).alias("state"), feature)
    return in_parts(named, "state", most, feature).groupBy("state", F.col("__part").alias("part")).agg(
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("geojson")
    )


def append_audit(audits: DataFrame, path: str, created_at: Column) -> int:
    """Adds to the log, by day; nothing that is there is touched. Returns the number of audits."""
    dated = audits.withColumns({"created_at": created_at, "audit_schema": F.lit("audit-v1")}).withColumn("dt", F.to_date("created_at"))
    dated, seen = observed(dated)
    dated.write.mode("append").partitionBy("dt").json(path)
    return seen.get["rows"]


def write_text(rows: DataFrame, path: str, column: str = "text") -> int:
    texts, seen = observed(rows.select(column))
    texts.write.mode("overwrite").text(path)
    return seen.get["rows"]


def manifest(members: dict[str, str | None]) -> list[dict[str, object]]:
    return [{"name": k, "characters": len(v)} for k, v in members.items() if v is not None]


def package(members: dict[str, str | None]) -> bytes:
    """A ZIP of one report's documents with a manifest; members that are None are left out."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            if text is not None:
                z.writestr(name, text)
        z.writestr("manifest.json", json.dumps(manifest(members), indent=2))
    return out.getvalue()


def packages(reports: DataFrame) -> DataFrame:
    """report_id, package: a ZIP per report from columns report_id, text, audit (null if there is none) and review."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [package({"report.md": t or "", "audit.json": a, "review.json": r}) for t, a, r in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["report_id", "package"])

    return reports.select(F.col("report_id").cast("string"), "text", "audit", "review").mapInArrow(run, "report_id string, package binary")
