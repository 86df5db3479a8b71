"""Sinks that publish on commit, and counts that ride on a write."""

from __future__ import annotations

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from terravane.operators import lineage, published, sinks


def features(spark, n=900):
    shape = lambda k: json.dumps({"type": "Feature", "properties": {"k": k, "name": "a,]}b"}})
    rows = [(shape(k), "New South Wales" if k % 3 else [None, "", "Victoria"][k // 3 % 3]) for k in range(n)]
    return spark.createDataFrame([*rows, (None, "Victoria")], "feature string, state string").repartition(4)


def names(path):
    return sorted(x for x in os.listdir(path))


def test_collections_are_valid_and_split(spark, tmp_path):
    path = f"{tmp_path}/c"
    files = published.write_collections(features(spark), path, most=100)
    assert {f["folder"] for f in files} == {"New_South_Wales", "Victoria", "Unknown"} and sum(f["rows"] for f in files) == 900
    assert max(f["rows"] for f in files) <= 100 and len([f for f in files if f["folder"] == "New_South_Wales"]) >= 6
    seen = []
    for f in files:
        with open(f"{path}/{f['name']}", encoding="utf-8") as x:
            whole = x.read()
        assert len(whole.encode()) == f["bytes"]
        one = json.loads(whole)
        assert one["type"] == "FeatureCollection" and len(one["features"]) == f["rows"]
        seen += [y["properties"]["k"] for y in one["features"]]
    assert sorted(seen) == list(range(900))
    back = published.read_collections(spark, path)
    assert sorted(json.loads(r.feature)["properties"]["k"] for r in back.collect()) == list(range(900))
    assert {r.folder: r["count"] for r in back.groupBy("folder").count().collect()} == {"New_South_Wales": 600, "Victoria": 100, "Unknown": 200}
    # Overwriting replaces, appending adds.
    published.write_collections(features(spark, 30), path)
    assert published.read_collections(spark, path).count() == 30 and len([x for x in names(path) if x.startswith("job-")]) == 1
    published.write_collections(features(spark, 3), path, mode="append")
    assert published.read_collections(spark, path).count() == 33
    published.write_collections(features(spark, 30).limit(0), path)
    assert published.read_collections(spark, path).count() == 0 and published.published(f"{tmp_path}/none") == []


def test_a_feature_larger_than_a_file_and_rows_in_any_order(spark, tmp_path):
    published.register(spark)
    rows = spark.createDataFrame([(f"s{k % 2}", json.dumps({"k": "x" * (10 if k % 5 else 400)}, indent=1)) for k in range(40)], "folder string, feature string").coalesce(1)
    rows.write.format("published_features").options(path=f"{tmp_path}/c", largest=300).mode("append").save()
    files = published.published(f"{tmp_path}/c")
    assert sum(f["rows"] for f in files) == 40 and all(f["bytes"] <= 300 + 60 or f["rows"] == 1 for f in files)
    assert published.read_collections(spark, f"{tmp_path}/c").count() == 40


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    path = f"{tmp_path}/c"
    published.write_collections(features(spark, 60), path)
    before = names(path)
    bad = features(spark, 600).withColumn("feature", F.when(F.col("feature").contains('"k": 577,'), F.raise_error(F.lit("lost"))).otherwise(F.col("feature")))
    with pytest.raises(Exception, match="lost"):
        published.write_collections(bad, path, mode="append")
    broken = spark.createDataFrame([(f"f{k}", None if k == 77 else "{}") for k in range(90)], "folder string, feature string").repartition(3)
    with pytest.raises(Exception):
        broken.write.format("published_features").options(path=path).mode("overwrite").save()
    assert names(path) == before and published.read_collections(spark, path).count() == 60


def test_what_failed_attempts_left_is_not_published(tmp_path):
    class Row:
        folder, feature = "a", "{}"

    w = published.FeatureWriter({"path": f"{tmp_path}/c"}, False)
    first, second = w.write(iter([Row, Row])), w.write(iter([Row]))
    w.commit([second, None])
    (shown,) = published.published(f"{tmp_path}/c")
    there = [os.path.join(d, f) for d, _, fs_ in os.walk(f"{tmp_path}/c") for f in fs_]
    assert shown["rows"] == 1 and first.files[0]["name"] != second.files[0]["name"]
    assert sorted(x.rpartition("/")[2] for x in there) == sorted([shown["name"].rpartition("/")[2], published.LIST])


def test_packages(spark, tmp_path):
    reports = spark.createDataFrame([("r/1", "text", None, "{}"), ("r/1", "again", "{}", None), ("", None, None, None)], "report_id string, text string, audit string, review string")
    files = published.write_packages(reports, f"{tmp_path}/p")
    published.write_packages(reports.limit(1), f"{tmp_path}/p")
    assert len(files) == 3 and len(published.published(f"{tmp_path}/p")) == 4
    opened = []
    for f in files:
        with open(f"{tmp_path}/p/{f['name']}", "rb") as x:
            z = zipfile.ZipFile(io.BytesIO(x.read()))
        opened.append((f["name"].rpartition("/")[2], z.read("report.md").decode(), len(json.loads(z.read("manifest.json")))))
    assert sorted(opened) == [("r_1.zip", "again", 2), ("r_1.zip", "text", 2), ("report.zip", "", 1)]


def test_counts_ride_on_the_write(spark, tmp_path):
    f = spark.range(90).select(F.col("id").cast("string").alias("feature"), F.lit("Victoria").alias("state"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    assert sinks.write_csv(f, f"{tmp_path}/csv", ["state"]) == 90
    assert len(tracker.getJobIdsForGroup("counted")) == 1  # no second scan
    spark.sparkContext.setJobGroup("rest", "rest")
    assert sinks.write_text(f, f"{tmp_path}/t", "feature") == 90 == spark.read.text(f"{tmp_path}/t").count()
    assert sinks.write_features_by_state(f.withColumnRenamed("state", "state_name_2021"), f"{tmp_path}/s") == 90
    assert sinks.append_audit(f, f"{tmp_path}/a", F.lit("2024-01-01").cast("timestamp")) == 90
    probes = spark.createDataFrame([("Reachable",), ("Check failed",), ("Check warning",), ("Reachable",)], "status string")
    watched, seen = sinks.observed(probes, **lineage.probe_measures())
    watched.write.parquet(f"{tmp_path}/probes")
    plain = lineage.probe_summary(probes).first()
    assert seen.get == {"total": 4, "reachable": 2, "failed": 1} and (plain.total, plain.reachable, plain.failed, plain.warnings) == (4, 2, 1, 1)
