"""Column builders, texts, checks, sources, sinks and streams."""

from __future__ import annotations

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from terravane import fixed, schemas
from terravane.functions import expr, lint, text
from terravane.operators import sinks
from terravane.sources import paged, tables, xlsx
from terravane.streaming import alerts


def one(spark, column, *values):
    """The column for each value of x."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, x string")
    return [r.y for r in df.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_rounding_equals_python(spark):
    r = random.Random(1)
    pairs = [(r.randint(0, 400), r.randint(1, 2000)) for _ in range(5000)] + [(1, 16), (1, 2000), (0, 3)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", expr.ratio_pct(F.col("a"), F.col("b")).alias("p"))
    assert all(x.p == round(x.a / x.b * 100, 1) for x in df.collect())


def test_scalars(spark):
    assert one(spark, expr.strip, "\t x y \n", "", None) == ["x y", "", None]
    assert one(spark, expr.count_of, "12.7", "", "x", None, "5") == [12, 0, 0, 0, 5]
    assert one(spark, lambda x: expr.slug(x, 8), "Mount Isa, QLD!", "  ", "Ünï", "abcdefg hij") == ["mount_is", "unknown", "ünï", "abcdefg_"]
    assert one(spark, expr.file_slug, "New South Wales", "(a)b") == ["New_South_Wales", "a_b"]
    assert one(spark, expr.md_value, "a|b\nc ", "", None) == ["a/b c", fixed.UNKNOWN, fixed.UNKNOWN]
    assert one(spark, lambda x: expr.with_unit(x, "%"), "5", "") == ["5 %", ""]
    assert one(spark, expr.html_escape, "<a & \"b\">") == ["&lt;a &amp; &quot;b&quot;&gt;"]
    assert one(spark, expr.column_index, "A1", "Z9", "AA10", "BC2") == [0, 25, 26, 54]
    assert one(spark, expr.header_name, " Area  Albers\tSQKM ") == ["area_albers_sqkm"]
    assert one(spark, lambda x: expr.status_message(x.cast("int")), "204", "301", "403", "404", "503", "418")[2].startswith("Official site is reachable")
    assert one(spark, lambda x: expr.has_keyword(x, "wa"), "perth wa", "wagga", "wa") == [True, False, True]
    assert one(spark, lambda x: expr.has_keyword(x, "wa", "substring"), "wagga", "") == [True, False]
    assert one(spark, lambda x: expr.support_band(x.cast("double"), F.lit(5)), "20", "19.9", "8", "7.9") == ["high", "medium", "medium", "low"]
    assert one(spark, lambda x: expr.quoted_in_list(F.array(x, F.lit("b"))), "O'Hara") == ["('O''Hara','b')"]
    assert one(spark, lambda x: expr.url_query({"where": x}), "a = 'b'") == ["where=a+%3D+%27b%27"]


REPORT = "# Title\n\n## Roles\nx\n\n## Next\ny"


def test_sections(spark):
    cut = lambda x: text.remove_section(x, "## Roles")
    assert one(spark, cut, REPORT, "a\n## Roles\nx", "none", "") == ["# Title\n\n## Next\ny", "a", "none", ""]
    added = one(spark, lambda x: text.with_section(text.with_section(x, "## Roles", F.lit("## Roles\nnew")), "## Roles", F.lit("## Roles\nnew")), REPORT)[0]
    assert added == "# Title\n\n## Next\ny\n\n## Roles\nnew\n"


def test_notice(spark):
    altered = "**DRAFT STATUS NOTICE**\n\nchanged\n\nSafety disclaimer: other.\n\n# Body"
    unsaid = "**DRAFT STATUS NOTICE**\nno more\n# Body"
    once = one(spark, text.governed, "# Body", altered, unsaid, None)
    assert once[0] == once[1] == once[2] == fixed.NOTICE + "\n\n# Body"
    assert one(spark, text.governed, *once)[:3] == once[:3]


def test_cleaning(spark):
    said = "A\n```json\n{\"a\": 1}\n```\nchecklist_update(x) has been called.\nSee https://a.b/c?d now\n\n\n\nCall `plan_complete` function at once\nEnd plan_complete"
    assert one(spark, text.clean_model_output, said, None) == ["A\n\nSee [verify through the relevant official source] now\n\nEnd", ""]


def test_blocks_and_meta(spark):
    md = "# Report\n# **Plan** A\nLocation: here\nAudience : all\n| a | b |\n| --- | :-: |\n| 1 |  |\n\n- [ ] do\n- x\n1. y\n### z\nLocation: there"
    df = spark.createDataFrame([(1, md), (2, ""), (3, "short line"), (4, "x" * 90)], "id long, text string")
    kinds = [r.kind for r in text.blocks(df, "id").filter("id = 1").orderBy("block_no").collect()]
    assert kinds == ["h1", "h1", "paragraph", "paragraph", "table", "checkbox", "bullet", "numbered", "h3", "paragraph"]
    meta = {r.id: (r.title, r.location) for r in text.report_meta(df, "id").collect()}
    assert meta == {1: ("Plan A", "there"), 2: (fixed.DEFAULT_TITLE, fixed.UNKNOWN), 3: ("short line", fixed.UNKNOWN), 4: (fixed.DEFAULT_TITLE, fixed.UNKNOWN)}
    assert one(spark, text.is_separator_row, "| --- | :-: |", "| a | - |", "|  |") == [True, False, False]
    assert one(spark, text.table_cells, "| a | b |") == [["a", "b"]]
    assert one(spark, text.inline_html, "**a** & `b`") == ["<b>a</b> &amp; <code>b</code>"]
    assert one(spark, lambda x: text.with_heading(x, "T"), "x", "# y") == ["# T\n\nx", "# y"]


GOOD = " ".join(fixed.REQUIRED_SECTIONS) + " BoM 000 fire service local council live evacuation order day 1 - [ ] teacher student community indicators official source register evidence confidence and provenance o1 p2 r3 a4 u0 human review sign-off draft"


def test_lint(spark):
    df = spark.createDataFrame([(1, GOOD), (2, ""), (3, None), (4, "library confirmed safe 12000")], "id long, text string")
    got = {r.id: r for r in lint.lint(df).collect()}
    assert tuple(got[1].summary) == (11, 0, 0, 11) and tuple(got[2].summary) == tuple(got[3].summary) == (1, 8, 2, 11)
    assert {c.name: c.status for c in got[4].checks}["Assembly point wording"] == "fail" and {c.name: c.status for c in got[4].checks}["Emergency number 000"] == "pass"
    assert got[2].checks[0].detail == "Potentially missing: " + ", ".join(fixed.REQUIRED_SECTIONS)


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿location,state,risk_notes\nA,Q,"two\nlines, ""quoted"""\nB,,\n', encoding="utf-8")
    got = tables.read_csv(spark, f"{tmp_path}/c.csv", schemas.COMMUNITY_PROFILES).orderBy("seq").collect()
    assert [(r.location, r.state, r.risk_notes, r.population) for r in got] == [("A", "Q", 'two\nlines, "quoted"', None), ("B", None, None, None)]
    assert tables.read_csv(spark, f"{tmp_path}/none.csv", schemas.LGA_SUMMARY).count() == 0
    assert tables.read_community(spark, f"{tmp_path}/none.csv", f"{tmp_path}/c.csv").count() == 2
    sinks.write_csv(spark.createDataFrame([("x", 'a "b", c')], "location string, state string"), f"{tmp_path}/out", ["state", "location"], one_file=True)
    assert tables.read_csv(spark, f"{tmp_path}/out", schemas.strings("location", "state")).first().state == 'a "b", c'


def test_yaml_json(spark, tmp_path):
    (tmp_path / "r.yml").write_text("rules:\n- id: a\n  match: {location_keywords: [x, y]}\n  risk_points: [p]\n- id: b\n")
    got = tables.read_yaml(spark, f"{tmp_path}/r.yml", "rules", schemas.DDL["rules"]).orderBy("seq").collect()
    assert got[0].match.location_keywords == ["x", "y"] and got[1].match.location_keywords is None and [r.seq for r in got] == [0, 1]
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"sa2_name_2021": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2]]]}}]}))
    assert tables.read_boundaries(spark, str(tmp_path), "g").first().features[0].geometry.coordinates.replace(" ", "") == "[[[1,2]]]"
    assert tables.read_json(spark, f"{tmp_path}/bad.json", schemas.DDL["features"]).count() == 0 == tables.read_json(spark, f"{tmp_path}/none.json", schemas.DDL["features"]).count()
    status = {r.path: r.files for r in tables.file_status(spark, [str(tmp_path / "r.yml"), "/none/such"]).collect()}
    assert status == {str(tmp_path / "r.yml"): 1, "/none/such": 0}


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>LGA  Code 2025</t></si><si><r><t>State</t></r><r><t> Name 2021</t></r></si><si><t>NSW</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>10</v></c><c r="C2" t="s"><v>2</v></c></row><row/><row><c r="A4" t="inlineStr"><is><t>ZZ</t></is></c></row></sheetData></worksheet>')
    got = xlsx.read_xlsx(spark, f"{tmp_path}/b.xlsx", schemas.LGA_ALLOCATION).orderBy("seq").collect()
    assert [(r.lga_code_2025, r.state_name_2021, r.lga_name_2025) for r in got] == [("10", "NSW", ""), ("ZZ", "", "")]


def test_pages(spark, tmp_path):
    for offset, codes in ((0, "ab"), (2, "c")):
        (tmp_path / f"page-{offset}.json").write_text(json.dumps({"features": [{"attributes": {"sa2_code_2021": c, "erp_p_202022": ord(c)}} for c in codes]}))
    paged.register(spark)
    df = spark.read.format("paged_features").schema("sa2_code_2021 string, erp_p_202022 string").option("limit", 2).load(str(tmp_path))
    assert sorted((r.sa2_code_2021, r.erp_p_202022) for r in df.collect()) == [("a", "97"), ("b", "98"), ("c", "99")]
    assert df.filter(F.col("sa2_code_2021").isin("a", "c")).count() == 2
    assert tables.saved_pages(spark, str(tmp_path), schemas.strings("sa2_code_2021", "erp_p_202022")).count() == 3
    assert paged.where_clause([]) == "1=1" and paged.where_clause([("n", ["O'x"])]) == "n IN ('O''x')"


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("A", "New South Wales"), ("B", None), ("C", "Victoria")], "sa2_name string, state_name_2021 string")
    sinks.write_features_by_state(f, f"{tmp_path}/s")
    back = spark.read.json(f"{tmp_path}/s")
    assert {r.sa2_name: r.state_slug for r in back.collect()} == {"A": "New_South_Wales", "B": "Unknown", "C": "Victoria"}
    for day in ("2024-01-01", "2024-01-02"):
        sinks.append_audit(spark.createDataFrame([("r", 1)], "report_id string, report_version int"), f"{tmp_path}/a", F.lit(day).cast("timestamp"))
    assert spark.read.json(f"{tmp_path}/a").count() == 2
    z = zipfile.ZipFile(io.BytesIO(sinks.package({"report.md": "x", "audit.json": None})))
    assert z.namelist() == ["report.md", "manifest.json"] and json.loads(z.read("manifest.json")) == [{"name": "report.md", "characters": 1}]
    made = sinks.packages(spark.createDataFrame([("r", "t", None, "{}")], "report_id string, text string, audit string, review string")).first()
    assert zipfile.ZipFile(io.BytesIO(made.package)).namelist() == ["report.md", "review.json", "manifest.json"]
    table = text.md_table(f.withColumn("o", F.col("sa2_name")), {"Unit": "sa2_name", "State": "state_name_2021"}, "o").first().text
    assert table.split("\n")[2] == "| A | New South Wales |" and table.split("\n")[3].endswith(f"| {fixed.UNKNOWN} |")


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    query = alerts.window_summary(stream).writeStream.format("memory").queryName("summed").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("summed").agg(F.sum("n")).first()[0] == events.count() == alerts.window_summary(events).agg(F.sum("n")).first()[0]
    assert alerts.keyword_alerts(events, ["CLICK"]).count() == events.filter("event_type = 'click'").count()
    rules = spark.createDataFrame([("r", ["click", "error"])], "id string, keywords array<string>")
    assert alerts.rule_alerts(events, rules).count() == events.filter("event_type in ('click', 'error')").count()
    assert alerts.sessions(events).agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize("name", ["q01_area_rollup", "q10_bidir_first", "q16_lint_rows", "q22_section_cut"])
def test_catalogue_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("region", "nation", "customer", "conversations"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got = entry.queries()[name](spark, d)
    want = c.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(x) for x in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5 and set(entry.oracle_sql()) <= set(entry.queries())


def test_paged_service_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    asked = []
    codes = [f"c{k}" for k in range(7)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            p = {k: v[0] for k, v in parse_qs(at.query).items()}
            asked.append((at.path, p))
            own = [c for c in codes if p["where"] == "1=1" or f"'{c}'" in p["where"]]
            if "returnCountOnly" in p:
                said = {"count": len(own)} if at.path == "/counted" else {}
            else:
                k, n = int(p["resultOffset"]), int(p["resultRecordCount"])
                said = {"features": [{"attributes": {"code": c, "n": 1}} for c in own[k : k + n]]}
            body = json.dumps(said).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        paged.register(spark)
        for name, partitions in (("counted", 3), ("uncounted", 1)):
            url = f"http://127.0.0.1:{server.server_port}/{name}"
            df = spark.read.format("paged_features").schema("code string, n string").options(url=url, service="terravane.sources.paged:Rest", limit=3).load()
            assert sorted(r.code for r in df.collect()) == codes and df.rdd.getNumPartitions() == partitions
            asked.clear()
            assert [r.code for r in df.filter(F.col("code").isin("c2", "c9")).select("code", "n").collect()] == ["c2"]
            assert all(p["where"] == "code IN ('c2','c9')" for _, p in asked) and any(p.get("outFields") == "code,n" for _, p in asked)
    finally:
        server.shutdown()


def test_meta_blocks_and_widths_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "|a|\n|b|c|\n\n|d|\nx\r\ny"), (None, "# T")], "id long, text string")
    got = {(r.id, r.block_no): (r.kind, r.first_line, r.lines) for r in text.blocks(df, "id").collect()}
    assert got == {(3, 1): ("table", 0, ["|a|", "|b|c|"]), (3, 3): ("table", 3, ["|d|"]), (3, 4): ("paragraph", 4, ["x"]), (3, 5): ("paragraph", 5, ["y"]), (None, 1): ("h1", 0, ["# T"])}
    assert "Exchange" not in text.blocks(df, "id")._jdf.queryExecution().toString()
    assert {r.id: r.title for r in text.report_meta(df, "id").collect()} == {1: fixed.DEFAULT_TITLE, 2: fixed.DEFAULT_TITLE, 3: "|a|", None: "T"}
    widths = spark.createDataFrame([(["|a|", "|b|c|"],), ([],), (None,)], "x array<string>").select(text.table_width(F.col("x")))
    assert [r[0] for r in widths.collect()] == [2, 0, 0]


def test_elapsed_and_parts(spark):
    from terravane.functions.expr import elapsed_ms

    t = spark.sql("SELECT timestamp'2024-01-01 00:00:00.250' AS a, timestamp'2024-01-01 00:00:01.5' AS b, CAST(NULL AS timestamp) AS c")
    assert tuple(t.select(elapsed_ms(F.col("a"), F.col("b")), elapsed_ms(F.col("a"), F.col("c"))).first()) == (1250, None)
    f = spark.createDataFrame([(f"f{k}", "Q" if k % 10 else None) for k in range(200)], "feature string, state string")
    got = sinks.collections(f, "feature", most=20).collect()
    assert sum(len(json.loads(r.geojson)["features"]) for r in got) == 200 and len({(r.state, r.part) for r in got}) == len(got) > 5
    assert {r.state for r in got} == {"Q", "Unknown"} and max(len(json.loads(r.geojson)["features"]) for r in got) < 60
