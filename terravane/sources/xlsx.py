"""The first sheet of XLSX workbooks as rows of strings.

read_xlsx() reads each workbook in one task. read_large_xlsx() gives equal rows from many: one task inflates the sheet and cuts
it after rows into pieces, which is little work and holds a piece at a time; the pieces are dealt out and parsed by as many
tasks as there are, each with the shared strings that its cells name.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from itertools import chain
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of sheet XML in a piece.
PIECE = 8 << 20
ROW_BEGIN, ROW_END = re.compile(rb"<(?:\w+:)?row[\s/>]"), re.compile(rb"</(?:\w+:)?row\s*>")
SHARED = "xl/sharedStrings.xml"
NS = {"s": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def first_sheet(z: zipfile.ZipFile) -> str | None:
    sheets = [n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    return min(sheets, key=lambda n: int(re.search(r"\d+", n)[0]), default=None)


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """Non-blank rows of the first sheet; cells that are left out are blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in x.iterfind(".//s:t", NS)) for x in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("s:si", NS)]
        if (sheet := first_sheet(z)) is None:
            return
        with z.open(sheet) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{{{NS['s']}}}row":
                    continue
                cells: dict[int, str] = {}
                for k, c in enumerate(row.iterfind("s:c", NS)):
                    at = _column(c.get("r", "")) if c.get("r") else k
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iterfind(".//s:t", NS))
                    else:
                        v = c.findtext("s:v", "", NS)
                        cells[at] = shared[int(v)] if c.get("t") == "s" and v else v
                row.clear()
                if any(v.strip() for v in cells.values()):
                    yield [cells.get(k, "") for k in range(max(cells) + 1)]


def header_name(x: str) -> str:
    return "_".join(x.split()).lower()


def read_xlsx(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of schema (by normalised header) and seq of each workbook; absent and blank cells are blank."""
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = sheet_rows(content.as_py())
                place = {header_name(h): k for k, h in enumerate(next(rows, []))}
                held: list[list[str]] = []
                done = 0
                for r in chain(rows, [None]):
                    if r is not None:
                        held.append([r[place[n]] if n in place and place[n] < len(r) else "" for n in names])
                    if held and (r is None or len(held) == 5000):
                        columns = [pa.array(c, pa.string()) for c in zip(*held)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(range(done, done + len(held)), pa.int64())], [*names, "seq"])
                        done, held = done + len(held), []

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, StructType([*schema.fields, *StructType().add("seq", "long").fields])).select(*(F.col(n) for n in names), "seq")


def sheet_pieces(content: bytes, size: int) -> Iterator[bytes]:
    """The first sheet's rows as XML documents of about `size` bytes, each under the sheet's own root element."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if (sheet := first_sheet(z)) is None:
            return
        with z.open(sheet) as f:
            held, root = b"", None
            while True:
                got = f.read(min(1 << 20, max(size, 1 << 14)))
                held += got
                if root is None:
                    begin = ROW_BEGIN.search(held)
                    if begin is None:
                        if not got:
                            return
                        continue
                    root = re.search(rb"<((?:\w+:)?worksheet)\b[^>]*>", held)
                    held = held[begin.start() :]
                if got and len(held) < size:
                    continue
                ends = [m.end() for m in ROW_END.finditer(held)]
                if ends:
                    yield root[0] + held[: ends[-1]] + b"</" + root[1] + b">"
                    held = held[ends[-1] :]
                if not got:
                    return


def piece_rows(xml: bytes, strings: bytes | None) -> list[list[str]]:
    """Non-blank rows of a piece; strings: the shared strings' XML, deflated, of which only those that are named are held."""
    rows: list[dict[int, str | int]] = []
    for _, row in ET.iterparse(io.BytesIO(xml)):
        if row.tag != f"{{{NS['s']}}}row":
            continue
        cells: dict[int, str | int] = {}
        for k, c in enumerate(row.iterfind("s:c", NS)):
            at = _column(c.get("r", "")) if c.get("r") else k
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iterfind(".//s:t", NS))
            else:
                v = c.findtext("s:v", "", NS)
                cells[at] = int(v) if c.get("t") == "s" and v else v
        row.clear()
        rows.append(cells)
    wanted = {v for r in rows for v in r.values() if isinstance(v, int)}
    known = dict(shared_strings(strings, wanted)) if wanted else {}
    full = [{k: known[v] if isinstance(v, int) else v for k, v in r.items()} for r in rows]
    return [[r.get(k, "") for k in range(max(r) + 1)] for r in full if any(v.strip() for v in r.values())]


def shared_strings(strings: bytes | None, wanted: set[int]) -> Iterator[tuple[int, str]]:
    """Number and text of the wanted strings, read as they are inflated."""
    parser, inflate = ET.XMLPullParser(("end",)), zlib.decompressobj()
    no = 0
    for k in range(0, len(strings or b""), 1 << 16):
        parser.feed(inflate.decompress(strings[k : k + (1 << 16)]))
        for _, x in parser.read_events():
            if x.tag == f"{{{NS['s']}}}si":
                if no in wanted:
                    yield no, "".join(t.text or "" for t in x.iterfind(".//s:t", NS))
                x.clear()
                no += 1


def deflated(content: bytes) -> bytes | None:
    """The shared strings' XML, compressed as it is read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if SHARED not in z.namelist():
            return None
        pack, out = zlib.compressobj(1), []
        with z.open(SHARED) as f:
            while got := f.read(1 << 20):
                out.append(pack.compress(got))
        return b"".join([*out, pack.flush()])


def read_large_xlsx(spark: SparkSession, path: str, schema: StructType, piece: int = PIECE, tasks: int | None = None) -> DataFrame:
    """As read_xlsx(), with each sheet parsed by many tasks. Rows are parsed twice, as their numbers follow those of the pieces before."""
    names = [f.name for f in schema]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1)):
                whole = content.as_py()
                strings, head, before = deflated(whole), None, 0
                for no, xml in enumerate(sheet_pieces(whole, piece)):
                    if head is None and (found := piece_rows(xml, strings)):
                        head, before = found[0], no
                    row = [file, no, int(no == before), head or [], xml, strings]  # pieces before the header have no rows
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()))], ["file", "piece", "skip", "head", "xml", "strings"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, no, skip, head, xml, strings in zip(*(b.column(k) for k in range(6))):
                place = {header_name(h): k for k, h in enumerate(head.as_py())}
                rows = piece_rows(xml.as_py(), strings.as_py())[skip.as_py() :]
                for k in range(0, len(rows), 5000):
                    part = rows[k : k + 5000]
                    columns = [pa.array([r[place[n]] if n in place and place[n] < len(r) else "" for r in part], pa.string()) for n in names]
                    own = [pa.array([file.as_py()] * len(part), pa.string()), pa.array([no.as_py()] * len(part), pa.int64()), pa.array(range(k, k + len(part)), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*own, *columns], ["__file", "__piece", "__at", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    pieces = files.mapInArrow(cut, "file string, piece long, skip long, head array<string>, xml binary, strings binary")
    dealt = pieces.repartition(tasks or max(8, 2 * spark.sparkContext.defaultParallelism), "file", "piece")
    own = StructType().add("__file", "string").add("__piece", "long").add("__at", "long")
    rows = dealt.mapInArrow(parse, StructType([*own.fields, *schema.fields]))
    # As many rows as there are pieces.
    counted = rows.groupBy("__file", "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__file").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select(F.col("__file").alias("__f"), F.col("__piece").alias("__p"), before.alias("__before"))
    joined = rows.join(F.broadcast(starts), (F.col("__file") == F.col("__f")) & (F.col("__piece") == F.col("__p")))
    return joined.select(*(F.col(n) for n in names), (F.col("__before") + F.col("__at")).alias("seq"))
