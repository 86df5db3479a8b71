"""Files that become visible together: written by tasks, published by the driver's commit.

Tasks write to a folder of their job whose name Spark's readers pass over. The commit drops what failed or repeated
attempts left, renames the folder and then replaces the list of published files, in one step each; an aborted job is deleted. So a reader of
the list sees all files of a job or none. Paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from terravane.functions.expr import blank_to, file_slug
from terravane.operators.sinks import in_parts, packages

#: The list of published files.
LIST = "published.json"
#: Bytes of a file of features at most, but for a single larger feature.
LARGEST = 256 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def published(path: str) -> list[dict[str, Any]]:
    """The files that a folder shows: name, rows, bytes."""
    store, root = opened(path)
    if store.get_file_info(f"{root}/{LIST}").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{root}/{LIST}") as f:
        return json.loads(f.read())["files"]


@dataclass
class Written(WriterCommitMessage):
    files: list[dict[str, Any]]


class Publisher(DataSourceWriter):
    """Base: a job's folder, its commit and its abort. name of a file: <job>/<folder>/<file>."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.most, self.largest = int(options.get("most", 10_000)), int(options.get("largest", LARGEST))

    def staged(self) -> tuple[fs.FileSystem, str]:
        store, root = opened(self.path)
        return store, f"{root}/_job-{self.job}"

    def commit(self, messages: list[Written | None]) -> None:
        store, stage = self.staged()
        files = [f for m in messages if m is not None for f in m.files]
        root = stage.rpartition("/")[0]
        store.create_dir(stage)
        kept = {f"{stage}/{f['name']}" for f in files}
        for info in store.get_file_info(fs.FileSelector(stage, recursive=True)):
            if info.type == fs.FileType.File and info.path not in kept:
                store.delete_file(info.path)
        before = [] if self.overwrite else published(self.path)
        store.move(stage, f"{root}/job-{self.job}")
        named = before + [{**f, "name": f"job-{self.job}/{f['name']}"} for f in files]
        with store.open_output_stream(f"{root}/_{self.job}.json") as out:
            out.write(json.dumps({"files": named}, indent=1).encode())
        store.move(f"{root}/_{self.job}.json", f"{root}/{LIST}")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if info.type == fs.FileType.Directory and info.base_name.startswith("job-") and info.base_name != f"job-{self.job}":
                    store.delete_dir(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, stage = self.staged()
        if store.get_file_info(stage).type != fs.FileType.NotFound:
            store.delete_dir(stage)


class FeatureWriter(Publisher):
    """Rows (folder, feature as JSON) as FeatureCollections; a folder's next file begins at `most` features or `largest` bytes.

    Rows sorted by folder make as few files as there can be; any order gives valid ones.
    """

    def write(self, iterator: Iterator[Row]) -> Written:
        store, stage = self.staged()
        files: list[dict[str, Any]] = []
        out, folder, task = None, None, uuid.uuid4().hex
        for row in iterator:
            body = row.feature.replace("\r", " ").replace("\n", " ").encode()  # line breaks of JSON are white space
            if out is not None and (row.folder != folder or files[-1]["rows"] >= self.most or files[-1]["bytes"] + len(body) > self.largest):
                self.close(out, files[-1])
                out = None
            if out is None:
                folder = row.folder
                store.create_dir(f"{stage}/{folder}")
                files.append({"name": f"{folder}/part-{task}-{len(files)}.geojson", "folder": folder, "rows": 0, "bytes": 0})
                out = store.open_output_stream(f"{stage}/{files[-1]['name']}")
                self.put(out, files[-1], b'{"type":"FeatureCollection","features":[\n')
            self.put(out, files[-1], (b",\n" if files[-1]["rows"] else b"") + body)
            files[-1]["rows"] += 1
        if out is not None:
            self.close(out, files[-1])
        return Written(files)

    def put(self, out: Any, file: dict[str, Any], body: bytes) -> None:
        out.write(body)
        file["bytes"] += len(body)

    def close(self, out: Any, file: dict[str, Any]) -> None:
        self.put(out, file, b"\n]}\n")
        out.close()


class FileWriter(Publisher):
    """Rows (folder, name, body) as one file each."""

    def write(self, iterator: Iterator[Row]) -> Written:
        store, stage = self.staged()
        files = []
        for row in iterator:
            body = bytes(row.body)
            folder = f"{row.folder}/{uuid.uuid4().hex}"  # names may repeat; an attempt's folder is its own
            store.create_dir(f"{stage}/{folder}")
            with store.open_output_stream(f"{stage}/{folder}/{row.name}") as out:
                out.write(body)
            files.append({"name": f"{folder}/{row.name}", "folder": row.folder, "rows": 1, "bytes": len(body)})
        return Written(files)


class PublishedFeatures(DataSource):
    """df.write.format("published_features") of columns folder and feature; options path, most, largest."""

    @classmethod
    def name(cls) -> str:
        return "published_features"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FeatureWriter(self.options, overwrite)


class PublishedFiles(DataSource):
    """df.write.format("published_files") of columns folder, name and body; option path."""

    @classmethod
    def name(cls) -> str:
        return "published_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for kind in (PublishedFeatures, PublishedFiles):
        spark.dataSource.register(kind)


def write_collections(features: DataFrame, path: str, feature: str = "feature", state: str = "state", most: int = 10_000, mode: str = "overwrite") -> list[dict[str, Any]]:
    """FeatureCollections by state of about `most` features a file, "Unknown" without a state; returns what is published."""
    register(features.sparkSession)
    keyed = features.select(file_slug(blank_to(F.col(state), "Unknown")).alias("folder"), F.col(feature).alias("feature")).filter("feature is not null")
    # A state's features are dealt out over as many tasks as they need; a task's file ends at `most` all the same.
    dealt = in_parts(keyed, "folder", most, "feature").repartition("folder", "__part").sortWithinPartitions("folder", "__part").select("folder", "feature")
    dealt.write.format("published_features").options(path=path, most=most).mode(mode).save()
    return published(path)


def write_packages(reports: DataFrame, path: str, mode: str = "append") -> list[dict[str, Any]]:
    """A ZIP per report (report_id, text, audit, review), in a folder by the first letters of its id's hash; returns what is published."""
    register(reports.sparkSession)
    made = packages(reports).select(F.substr(F.md5("report_id"), F.lit(1), F.lit(2)).alias("folder"), F.concat(blank_to(file_slug(F.col("report_id")), "report"), F.lit(".zip")).alias("name"), F.col("package").alias("body"))
    made.write.format("published_files").options(path=path).mode(mode).save()
    return published(path)


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """folder and feature (JSON) of all published collections."""
    files = [f"{path}/{f['name']}" for f in published(path)]
    if not files:
        return spark.createDataFrame([], "folder string, feature string")
    # A feature per line, between the lines of its collection.
    lines = spark.read.text(files).select(F.regexp_extract(F.input_file_name(), "/([^/]+)/[^/]+$", 1).alias("folder"), F.rtrim("value").alias("line"))
    kept = lines.filter(~F.col("line").isin('{"type":"FeatureCollection","features":[', "]}"))
    return kept.select("folder", F.regexp_replace("line", ",$", "").alias("feature"))
