"""Readers: CSV, YAML, JSON, GeoJSON, whole texts and file metadata, all with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terravane import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_csv(spark: SparkSession, path: str, schema: StructType, line_breaks: bool = True) -> DataFrame:
    """A CSV table of strings with the columns of schema and seq, the order in the file.

    Columns are found by header; absent ones are null, blanks are null, a byte order mark is skipped. With
    line_breaks quoted fields may hold them, and each file is read by one task; large files without any, such as
    allocations, are split. A missing path gives an empty table.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("seq", F.lit(0).cast("long"))
    raw = spark.read.options(header=True, multiLine=line_breaks, escape='"', encoding="UTF-8", inferSchema=False).csv(path)
    have = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    columns = [F.nullif(F.col(f"`{have[f.name.lower()]}`"), F.lit("")).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    # Ids follow the order of the lines within a file; they are neither dense nor small.
    return raw.select(*columns, F.monotonically_increasing_id().alias("seq"))


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, else the last."""
    return next((p for p in paths if exists(spark, p)), paths[-1])


def read_community(spark: SparkSession, processed: str, sample: str) -> DataFrame:
    """The processed community profiles, or the sample in their place."""
    return read_csv(spark, first_existing(spark, (processed, sample)), schemas.COMMUNITY_PROFILES)


def yaml_rows(text: str, key: str) -> list[dict[str, Any]]:
    import yaml

    return (yaml.safe_load(text) or {}).get(key, []) or []


def read_yaml(spark: SparkSession, path: str, key: str, ddl: str) -> DataFrame:
    """The list under a key of a YAML register, typed, with seq; a register is a small file by nature."""
    schema = schemas.typed(ddl)
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("seq", F.lit(0).cast("long"))
    rows = yaml_rows(spark.read.text(path, wholetext=True).first()[0], key)

    def fit(row: dict[str, Any], kind: StructType) -> tuple:
        out = []
        for f in kind:
            x = row.get(f.name)
            out.append(fit(x or {}, f.dataType) if isinstance(f.dataType, StructType) else [*x] if isinstance(x, list) else None if x is None else str(x))
        return tuple(out)

    numbered = StructType([*schema.fields, *StructType().add("seq", "long").fields])
    return spark.createDataFrame([(*fit(r, schema), k) for k, r in enumerate(rows)], numbered)


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON file with an explicit schema; a missing or corrupt one gives no row."""
    schema = schemas.typed(ddl)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    with_bad = StructType([*schema.fields, *StructType().add("_bad", "string").fields])
    raw = spark.read.schema(with_bad).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").json(path)
    # The second test is always true; it names a column, as Spark refuses to read that of bad records alone.
    return raw.filter(F.col("_bad").isNull() & (F.pmod(F.xxhash64(schema[0].name), F.lit(2)) < 2)).drop("_bad")


def read_boundaries(spark: SparkSession, root: str, state_slug: str | None = None, whole: str | None = None) -> DataFrame:
    """A GeoJSON collection: the state's own file if there is one, else the whole file."""
    path = f"{root}/{state_slug}.geojson" if state_slug else whole or root
    return read_json(spark, first_existing(spark, (path, whole or root)), schemas.DDL["features"])


def file_status(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, files, bytes, modified of files and folders; absent ones have no files."""
    wanted = spark.createDataFrame([(p,) for p in paths], "path string")
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return wanted.select("path", F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("timestamp").alias("modified"))
    found = None
    for p in there:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))
        one = one.withColumn("path", F.lit(p))
        found = one if found is None else found.unionByName(one)
    joined = wanted.join(found, "path", "left")
    return joined.select("path", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "modified")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def saved_pages(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The attributes (columns of strings in schema) of all features in saved pages of a feature service."""
    pages = spark.read.schema(schemas.typed("features array<struct<attributes:map<string,string>>>")).options(multiLine=True).json(path)
    attributes = pages.select(F.explode("features.attributes").alias("a"))
    return attributes.select(*(F.col("a")[f.name].alias(f.name) for f in schema))
