"""Large sheets read by many tasks, against the single reader."""

from __future__ import annotations

import random
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from terravane import schemas
from terravane.sources import xlsx

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
SCHEMA = schemas.strings("code", "state_name", "absent", "note")


def workbook(path, rows, prefix="", seed=1):
    """Shared, inline and plain cells, blank cells and rows, and rows without cells."""
    r = random.Random(seed)
    p = f"{prefix}:" if prefix else ""
    strings = ["Code", "State  Name", "Note", " ", *(f"shared {k} & <é>" for k in range(97))]
    cell = lambda ref, v: r.choice([f'<{p}c r="{ref}"><{p}v>{v}</{p}v></{p}c>', f'<{p}c r="{ref}" t="s"><{p}v>{r.randrange(4, 101)}</{p}v></{p}c>', f'<{p}c r="{ref}" t="inlineStr"><{p}is><{p}t>{escape(f"in <{v}>")}</{p}t></{p}is></{p}c>', ""])
    head = "".join(f'<{p}c r="{c}2" t="s"><{p}v>{k}</{p}v></{p}c>' for k, c in enumerate("ABD"))
    body = [f"<{p}row/>", f"<{p}row>{head}</{p}row>"]
    for k in range(rows):
        body.append(f'<{p}row r="{k + 3}"/>' if k % 11 == 5 else f'<{p}row r="{k + 3}"><{p}c r="A{k + 3}" t="s"><{p}v>3</{p}v></{p}c></{p}row>' if k % 13 == 7 else f'<{p}row r="{k + 3}">' + "".join(cell(f"{c}{k + 3}", k) for c in "ABCD") + f"</{p}row>")
    ns = f'xmlns{":" + prefix if prefix else ""}="{NS}"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<sst xmlns=\"{NS}\">" + "".join(f"<si><t>{escape(x)}</t></si>" for x in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{NS}"><sheetData><row><c><v>other</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0"?><{p}worksheet {ns}><{p}sheetData>{"".join(body)}</{p}sheetData><{p}pageMargins left="1"/></{p}worksheet>')


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda x: (x[-1], x))


@pytest.mark.parametrize("prefix", ["", "x"])
def test_equal_to_the_single_reader(spark, tmp_path, prefix):
    workbook(f"{tmp_path}/a.xlsx", 20_000, prefix)
    large = xlsx.read_large_xlsx(spark, f"{tmp_path}/a.xlsx", SCHEMA, piece=30_000)
    assert rows_of(large) == rows_of(xlsx.read_xlsx(spark, f"{tmp_path}/a.xlsx", SCHEMA))
    tasks = large.groupBy(F.spark_partition_id()).count()
    assert tasks.count() >= 8 and large.columns == [*SCHEMA.names, "seq"]
    assert sorted(r.seq for r in large.select("seq").collect()) == list(range(large.count()))


def test_several_and_odd_workbooks(spark, tmp_path):
    workbook(f"{tmp_path}/a.xlsx", 300)
    workbook(f"{tmp_path}/b.xlsx", 0, seed=2)
    workbook(f"{tmp_path}/c.xlsx", 500, seed=3)
    with zipfile.ZipFile(f"{tmp_path}/d.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{NS}"><sheetData/></worksheet>')
    with zipfile.ZipFile(f"{tmp_path}/e.xlsx", "w") as z:
        z.writestr("nothing.txt", "")
    for piece in (1, 2000, xlsx.PIECE):
        assert rows_of(xlsx.read_large_xlsx(spark, f"{tmp_path}/*.xlsx", SCHEMA, piece=piece)) == rows_of(xlsx.read_xlsx(spark, f"{tmp_path}/*.xlsx", SCHEMA))


def test_a_piece_is_all_that_is_held(tmp_path):
    workbook(f"{tmp_path}/a.xlsx", 30_000)
    with open(f"{tmp_path}/a.xlsx", "rb") as f:
        content = f.read()
    sizes = [len(x) for x in xlsx.sheet_pieces(content, 1 << 16)]
    assert len(sizes) >= 20 and max(sizes) < 3 << 16
    assert sum(len(xlsx.piece_rows(x, xlsx.deflated(content))) for x in xlsx.sheet_pieces(content, 1 << 16)) == sum(1 for _ in xlsx.sheet_rows(content))
