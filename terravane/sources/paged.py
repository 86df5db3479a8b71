"""A paged feature service as a Spark data source, for batches and streams.

A service answers for pages of (url, where, fields, offset, limit); the reader names its class by option. If it can
count, rows are dealt out in ranges of a page, and each range is read on from where a page came back short, until it is whole:
services that cap their pages lose nothing. What is missing in the end, or a count that has changed meanwhile, is an
error, never a smaller result. If it can't count, one partition asks page after page until an empty one. Filters on
columns go to the service as its predicate, and only the wanted columns are asked for.

As a stream, the source's offset is the number of rows read; rows are taken to be added at the end. A restarted query
goes on from its checkpoint.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from importlib import import_module
from typing import Any
from urllib.parse import urlencode
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Rows of a page unless the reader says otherwise, and seconds that a request may take.
PAGE, TIMEOUT = 2000, 60
#: The column of shapes.
GEOMETRY = "geometry"


def where_clause(filters: Sequence[tuple[str, Sequence[str]]]) -> str:
    """The remote predicate of column IN (values), quotes doubled; 1=1 without any."""
    if not filters:
        return "1=1"
    return " AND ".join(f"{c} IN ({','.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)})" for c, values in filters)


class IncompleteError(RuntimeError):
    """The service gave fewer rows than it counts, or its count changed while it was read."""


class Service:
    """What a service can be asked; made anew in each task."""

    def count(self, url: str, where: str) -> int | None:
        """Rows that fit, or None if the service can't say."""
        return None

    def page(self, url: str, where: str, fields: Sequence[str], offset: int, limit: int) -> dict[str, Any]:
        """{"features": [...]} and whatever else the service says; fewer than limit, if it caps its pages."""
        raise NotImplementedError


class Rest(Service):
    """A feature service over HTTP. A column named geometry holds the shape as GeoJSON, in degrees."""

    def ask(self, url: str, **parameters: str) -> dict[str, Any]:
        with urlopen(f"{url}?{urlencode({'f': 'json', **parameters})}", timeout=TIMEOUT) as answer:
            said = json.loads(answer.read().decode("utf-8"))
        if isinstance(said.get("error"), dict):  # such services answer 200 all the same
            raise RuntimeError(f"{url}: {said['error'].get('message', said['error'])}")
        return said

    def count(self, url: str, where: str) -> int | None:
        return self.ask(url, where=where, returnCountOnly="true").get("count")

    def page(self, url: str, where: str, fields: Sequence[str], offset: int, limit: int) -> dict[str, Any]:
        plain = [f for f in fields if f != GEOMETRY]
        shape = {"f": "geojson", "returnGeometry": "true", "outSR": "4326"} if GEOMETRY in fields else {"returnGeometry": "false"}
        return self.ask(url, where=where, outFields=",".join(plain) or "*", resultOffset=str(offset), resultRecordCount=str(limit), **shape)


class Saved(Service):
    """Pages in files named page-<offset>.json, in a folder that all machines see; the predicate was that of whoever saved them.

    For pages in any store that Spark reads there is tables.saved_pages().
    """

    def pages(self, url: str) -> list[int]:
        return sorted(int(x.removeprefix("page-").removesuffix(".json")) for x in os.listdir(url) if re.fullmatch("page-[0-9]+\\.json", x))

    def saved(self, url: str, offset: int) -> dict[str, Any]:
        with open(f"{url}/page-{offset}.json", encoding="utf-8") as f:
            return json.load(f)

    def count(self, url: str, where: str) -> int:
        """Where the last page ends; a page that is missing before it is noticed when it is read."""
        there = self.pages(url)
        return there[-1] + len(self.saved(url, there[-1]).get("features", [])) if there else 0

    def page(self, url: str, where: str, fields: Sequence[str], offset: int, limit: int) -> dict[str, Any]:
        first = [k for k in self.pages(url) if k <= offset]
        whole = self.saved(url, first[-1]) if first else {}
        return {**whole, "features": whole.get("features", [])[offset - first[-1] :] if first else []}


def service(name: str) -> Service:
    """A service by "module:class"."""
    module, _, kind = name.partition(":")
    return getattr(import_module(module), kind)()


class Range(InputPartition):
    """Rows from first to last; all from first on, if last is None. total is what the service counted."""

    def __init__(self, first: int, last: int | None, total: int | None) -> None:
        self.first, self.last, self.total = first, last, total


class Asking:
    """What batches and streams have in common: options, and the reading of a range."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = schema.names
        self.url, self.limit = options.get("url") or options["path"], int(options.get("limit", PAGE))
        if self.limit < 1:
            raise ValueError("limit must be positive")
        self.service = options.get("service", f"{__name__}:Saved")
        self.base = options.get("where", "")
        self.kept: list[tuple[str, list[str]]] = []

    def where(self) -> str:
        filters = where_clause(self.kept)
        return f"({self.base}) AND {filters}" if self.base and self.kept else self.base or filters

    def ranges(self, first: int, total: int) -> list[InputPartition]:
        return [Range(k, min(k + self.limit, total), total) for k in range(first, total, self.limit)] or [Range(first, first, total)]

    def batch(self, features: list[dict[str, Any]]) -> pa.RecordBatch:
        rows = [{**(x.get("attributes") or x.get("properties") or {}), **({GEOMETRY: json.dumps(x[GEOMETRY])} if x.get(GEOMETRY) else {})} for x in features]
        for c, values in self.kept:  # for services that can't
            rows = [r for r in rows if str(r.get(c)) in values]
        columns = [pa.array([None if r.get(n) is None else str(r[n]) for r in rows], pa.string()) for n in self.names]
        return pa.RecordBatch.from_arrays(columns, self.names)

    def read_range(self, part: Range) -> Iterator[pa.RecordBatch]:
        ask, at = service(self.service), part.first
        while part.last is None or at < part.last:
            want = self.limit if part.last is None else part.last - at
            got = ask.page(self.url, self.where(), self.names, at, want).get("features", [])[:want]
            if not got:
                break
            yield self.batch(got)
            at += len(got)  # a short page isn't the end: services cap their pages
        if part.last is not None and at < part.last:
            raise IncompleteError(f"{self.url}: {part.last - at} of rows {part.first} to {part.last} are missing")


class PagedReader(Asking, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and isinstance(f.value, str):
                self.kept.append((f.attribute[0], [f.value]))
            elif isinstance(f, In):
                self.kept.append((f.attribute[0], [str(v) for v in f.value]))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        total = service(self.service).count(self.url, self.where())
        return [Range(0, None, None)] if total is None else self.ranges(0, total)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.read_range(partition)
        if partition.total is not None:
            now = service(self.service).count(self.url, self.where())
            if now != partition.total:
                raise IncompleteError(f"{self.url}: had {partition.total} rows when reading began, now {now}")


class PagedStream(Asking, DataSourceStreamReader):
    """Rows by their place; what the service counts beyond the last batch is the next one, `most` rows at most."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        super().__init__(schema, options)
        self.most = int(options["most"]) if "most" in options else None
        self.planned = 0

    def initialOffset(self) -> dict[str, int]:
        return {"rows": 0}

    def latestOffset(self) -> dict[str, int]:
        total = service(self.service).count(self.url, self.where())
        if total is None:
            raise IncompleteError(f"{self.url}: a stream needs a service that can count")
        if total < self.planned:
            raise IncompleteError(f"{self.url}: had {self.planned} rows, now {total}")
        self.planned = total if self.most is None else min(total, self.planned + self.most)
        return {"rows": self.planned}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> Sequence[InputPartition]:
        self.planned = max(self.planned, end["rows"])
        return self.ranges(start["rows"], end["rows"])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from self.read_range(partition)

    def commit(self, end: dict[str, int]) -> None:
        """Nothing to let go of: the service keeps its rows, the query its offsets."""


class PagedFeatures(DataSource):
    """spark.read or readStream .format("paged_features").schema(columns of strings), with options url, service ("module:class"), limit (rows of a page), where; most (rows of a stream's batch)."""

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStream(schema, self.options)


class EnvelopeReader(Asking, DataSourceReader):
    """What the first page says besides its features."""

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        ask = service(self.service)
        first = ask.page(self.url, self.where(), ["*"], 0, self.limit)
        yield self.url, json.dumps({k: v for k, v in first.items() if k != "features"}), ask.count(self.url, self.where())


class PagedEnvelope(DataSource):
    """One row: source_url, envelope (JSON, as the first page has it), feature_count (null if the service can't count)."""

    @classmethod
    def name(cls) -> str:
        return "paged_envelope"

    def schema(self) -> str:
        return "source_url string, envelope string, feature_count long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return EnvelopeReader(schema, self.options)


class SingleReader(Asking, DataSourceReader):
    """One request; a service that says there is more has not answered it."""

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        got = service(self.service).page(self.url, self.where(), self.names, 0, self.limit)
        if got.get("exceededTransferLimit") or (got.get("properties") or {}).get("exceededTransferLimit"):
            raise IncompleteError(f"{self.url}: more rows than one answer holds")
        yield self.batch(got.get("features", []))


class SingleAnswer(DataSource):
    """spark.read.format("single_answer"): as paged_features, from one request for all rows."""

    @classmethod
    def name(cls) -> str:
        return "single_answer"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SingleReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, with filters pushed down to the service."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    for kind in (PagedFeatures, PagedEnvelope, SingleAnswer):
        spark.dataSource.register(kind)


def read(spark: SparkSession, schema: StructType | str, **options: str | int) -> DataFrame:
    register(spark)
    return spark.read.format("paged_features").schema(schema).options(**options).load()


def envelope(spark: SparkSession, **options: str | int) -> DataFrame:
    """source_url, envelope, feature_count of a service: what the collection made of its pages begins with."""
    register(spark)
    return spark.read.format("paged_envelope").options(**options).load()
