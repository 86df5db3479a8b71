"""Report texts as Markdown: notices, sections, tables, blocks and cleaning."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane import fixed
from terravane.functions.expr import blank_to, lstrip, md_value, rstrip, strip, with_unit


def _from(text: Column, at: Column) -> Column:
    return F.substring(text, at, F.length(text))


def _before(text: Column, at: Column) -> Column:
    return F.substring(text, F.lit(1), at - 1)


def remove_section(text: Column, heading: str) -> Column:
    """Without the first section of that heading, up to the next second-level heading."""
    at = F.instr(text, heading)
    next_ = F.call_function("locate", F.lit("\n## "), text, at + len(heading))
    head = rstrip(_before(text, at))
    return F.when(at == 0, text).when(next_ == 0, head).otherwise(F.concat(head, F.lit("\n\n"), lstrip(_from(text, next_ + 1))))


def remove_notice(text: Column) -> Column:
    """Without a draft notice, altered or not."""
    at = F.instr(text, fixed.NOTICE_MARK)
    said = F.call_function("locate", F.lit(fixed.DISCLAIMER_MARK), text, at)
    heading = F.call_function("locate", F.lit("\n#"), text, at + len(fixed.NOTICE_MARK))
    end = F.call_function("locate", F.lit("\n"), text, said)
    head = rstrip(_before(text, at))
    rest = F.when(end == 0, "").otherwise(lstrip(_from(text, end)))
    unsaid = F.when(heading == 0, head).otherwise(strip(F.concat(head, F.lit("\n\n"), lstrip(_from(text, heading + 1)))))
    return F.when(at == 0, text).when(said == 0, unsaid).otherwise(strip(F.concat(head, F.lit("\n\n"), rest)))


def governed(text: Column) -> Column:
    """The canonical notice before the text; a second call changes nothing."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(F.startswith(t, F.lit(fixed.NOTICE.strip())), t).otherwise(F.concat(F.lit(fixed.NOTICE + "\n\n"), lstrip(remove_notice(t))))


def with_section(text: Column, heading: str, section: Column) -> Column:
    """The section at the end, in place of an earlier one of that heading."""
    return F.concat(rstrip(remove_section(F.coalesce(text, F.lit("")), heading)), F.lit("\n\n"), section, F.lit("\n"))


def signoff(record: Mapping[str, Column]) -> Column:
    lines = [F.lit(x) for x in (fixed.SIGNOFF_HEADING, "", fixed.SIGNOFF_INTRO, "", "| Field | Value |", "| --- | --- |")]
    lines += [F.concat(F.lit(f"| {label} | "), md_value(record.get(key, F.lit(None))), F.lit(" |")) for label, key in fixed.SIGNOFF_FIELDS]
    return F.concat_ws("\n", *lines, F.lit(""), *map(F.lit, fixed.SIGNOFF_CHECKS))


def with_signoff(text: Column, record: Mapping[str, Column]) -> Column:
    return with_section(text, fixed.SIGNOFF_HEADING, signoff(record))


def row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def evidence_tables(a: str = "analysis") -> Column:
    """The evidence appendix of an analysis struct (see plans.analysis)."""
    c = lambda path: F.col(f"{a}.{path}")
    say = lambda x: F.array(F.lit(x))
    # Headings and notes of the tables.
    geography = [
        ("User location", c("profile.location"), "[U0] Form input; confirm with the responsible organisation"),
        ("Inferred state / territory", c("profile.state"), "[R3] Profile Agent text inference"),
        ("Selected ASGS level", c("area.selected_level"), "[P2] Local processed ABS ASGS allocation reference"),
        ("Selected ASGS area", c("area.selected_area"), "[P2] Map selection matched to local ASGS reference"),
        ("SA2 rows in selected area", c("area.sa2_count"), None),
        ("SA3 reference", c("area.sa3_names"), "[P2] Processed ABS ASGS hierarchy"),
        ("SA4 reference", c("area.sa4_names"), "[P2] Processed ABS ASGS hierarchy"),
        ("GCCSA reference", c("area.gccsa_names"), "[P2] Processed ABS ASGS hierarchy"),
        ("Albers area", with_unit(c("area.area_albers_sqkm"), "sq km"), "[P2] Processed ABS ASGS allocation area field"),
    ]
    indicators = [
        ("Matched community profile", c("community.matched_location"), "[P2] Processed geographic match"),
        ("Population", c("community.population"), "[P2] ABS-origin local processed data"),
        ("Older people percentage", with_unit(c("community.older_people_pct"), "%"), "[P2] Derived from processed ABS-origin fields"),
        ("Language other than English at home", with_unit(c("community.language_other_than_english_pct"), "%"), "[P2] Derived from processed ABS-origin fields"),
        ("Language support need", c("community.language_support_needed"), "[R3] Threshold-based interpretation of processed data"),
        ("Matched SA2 count", c("community.matched_sa2_count"), "[P2] Processed geographic aggregation"),
        ("Transport vulnerability", c("community.no_car_households_pct"), "[U0] To be confirmed if blank"),
    ]
    contributions = [
        ("Matched risk rules", F.array_join(c("risk.matched_rule_ids"), ", "), "[R3] Deterministic configured-rule match; validate locally"),
        ("Risk context", F.array_join(c("risk.risk_points"), "; "), "[R3] Rule-derived planning context, not observed incident evidence"),
        ("Planning priorities", F.array_join(c("plan.planning_priorities"), "; "), "[R3] Deterministic planning transformation"),
    ]
    source_file = F.concat(F.lit("[P2] "), md_value(c("area.source_file")))
    table = lambda rows: F.array(*(row(F.lit(k), md_value(v), source_file if note is None else F.lit(note)) for k, v, note in rows))
    each = lambda items, line, none: F.when(F.size(items) > 0, F.transform(items, line)).otherwise(say(none))
    evidence = c("evidence")
    # Notes, headings and column names of the tables below.
    limits = F.concat(c("sources.data_limitations"), c("area_limitations"), c("risk.assumptions"), F.array_compact(F.array(F.nullif(c("community.data_source_note"), F.lit("")))))
    lines = F.concat(
        F.array(*map(F.lit, (
            fixed.EVIDENCE_HEADING, "",
            "These tables are generated from local pipeline outputs to support human review and audit traceability. They are not live emergency data.", "",
            "### Evidence Confidence and Provenance", "",
            "Evidence codes describe provenance and required review. They are not fire danger ratings, live incident severity levels or guarantees of legal or operational reliability.", "",
            "| Code | Evidence class | Confidence / use boundary | Required review |", "| --- | --- | --- | --- |",
        ))),
        F.transform(evidence, lambda e: row(*(md_value(e[k]) for k in ("code", "evidence_class", "confidence_boundary", "required_review")))),
        F.array(*map(F.lit, ("", "**Current report application**", ""))),
        F.transform(evidence, lambda e: F.concat(F.lit("- **"), md_value(e["code"]), F.lit(" "), md_value(e["evidence_class"]), F.lit(":** "), md_value(e["current_use"]))),
        F.array(*map(F.lit, ("", "### Evidence Table 1: Selected Geography", "", "| Field | Value | Source / note |", "| --- | --- | --- |"))),
        table(geography),
        F.array(*map(F.lit, ("", "### Evidence Table 2: Community Indicators", "", "| Indicator | Value | Source / note |", "| --- | --- | --- |"))),
        table(indicators),
        F.array(*map(F.lit, ("", "### Evidence Table 3: LGA 2025 Candidate Reference", "", "| LGA code | LGA name | State / territory | Mesh blocks | Albers area | Source |", "| --- | --- | --- | --- | --- | --- |"))),
        each(
            c("lga_candidates"),
            lambda g: row(*(md_value(g[k]) for k in ("lga_code_2025", "lga_name_2025", "state_name_2021", "mesh_block_count")), md_value(with_unit(g["area_albers_sqkm"], "sq km")), F.concat(F.lit("[P2] "), md_value(g["source_file"]))),
            "| To be confirmed | To be confirmed | To be confirmed | To be confirmed | To be confirmed | [U0] No LGA candidate matched from local ASGS summary |",
        ),
        F.array(*map(F.lit, ("", "### Evidence Table 4: Official Source Register", "", "| Source | Purpose | URL |", "| --- | --- | --- |"))),
        each(
            c("sources.sources"), lambda s: row(F.concat(F.lit("[O1] "), md_value(s["name"])), md_value(s["purpose"]), md_value(s["url"])),
            "| [U0] To be confirmed | No official source matched by the data agent | To be confirmed |",
        ),
        F.array(*map(F.lit, ("", "### Evidence Table 5: Rule and AI Contributions", "", "| Contribution | Current output | Evidence level / note |", "| --- | --- | --- |"))),
        table(contributions),
        F.array(*map(F.lit, (
            "| Narrative report body | Generated by the configured language model | [A4] Draft synthesis; not an evidence source and requires human verification |",
            "", "### Evidence Table 6: Limitations Requiring Human Review", "",
        ))),
        F.transform(limits, lambda x: F.concat(F.lit("- "), md_value(x))),
    )
    return F.array_join(lines, "\n")


def clean_model_output(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    for pattern, to in fixed.MODEL_OUTPUT_PATTERNS:
        t = F.regexp_replace(t, pattern, to)
    return strip(t)


def plain(line: Column) -> Column:
    """A line without heading marks, bold and code marks."""
    t = F.regexp_replace(strip(line), "^#+\\s*", "")
    return strip(F.regexp_replace(F.regexp_replace(t, "\\*\\*(.+?)\\*\\*", "$1"), "`(.+?)`", "$1"))


def inline_html(text: Column) -> Column:
    """Bold and code as HTML, the rest escaped."""
    t = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(t, "\\*\\*(.+?)\\*\\*", "<b>$1</b>"), "`(.+?)`", "<code>$1</code>")


def is_table_line(line: Column) -> Column:
    return F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|"))


def table_cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, "^\\|+|\\|+$", ""), "\\|"), strip)


def table_width(lines: Column) -> Column:
    """The cells of a table's widest row; 0 without rows."""
    return F.coalesce(F.array_max(F.transform(lines, lambda x: F.size(table_cells(x)))), F.lit(0))


def is_separator_row(line: Column) -> Column:
    return F.forall(table_cells(line), lambda c: F.regexp_like(c, F.lit("^[-: ]*-[-: ]*$")))


def lines_of(text: Column) -> Column:
    """All lines, stripped."""
    return F.transform(F.split(text, "\r\n|\r|\n"), strip)


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no (from 0), line."""
    return docs.select(key, F.posexplode(lines_of(F.col(text)))).select(key, F.col("pos").alias("line_no"), F.col("col").alias("line"))


def kind(line: Column) -> Column:
    return (
        F.when(line == "", "blank").when(is_table_line(line), "table").when(F.startswith(line, F.lit("### ")), "h3").when(F.startswith(line, F.lit("## ")), "h2")
        .when(F.startswith(line, F.lit("# ")), "h1").when(F.regexp_like(line, F.lit("^[-*] \\[[ xX]\\] ")), "checkbox").when(F.regexp_like(line, F.lit("^[-*] ")), "bullet")
        .when(F.regexp_like(line, F.lit("^\\d+\\.\\s+")), "numbered").otherwise("paragraph")
    )


def blocks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, block_no, kind, first_line, lines: runs of table lines are one block, every other line its own.

    A report is one row, so its lines stay together: nothing is shuffled.
    """
    typed = docs.select(key, lines_of(F.col(text)).alias("__lines"))
    typed = typed.withColumn("__kinds", F.transform("__lines", kind))
    begins = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda k: (F.get("__kinds", k) != "table") | (k == 0) | (F.get("__kinds", k - 1) != "table"))
    starts = typed.withColumn("__starts", begins)
    block = F.transform(
        "__starts",
        lambda k, no: F.struct(
            (no + 1).alias("block_no"), F.get("__kinds", k).alias("kind"), k.alias("first_line"),
            F.slice("__lines", k + 1, F.coalesce(F.get("__starts", no + 1), F.size("__lines")) - k).alias("lines"),
        ),
    )
    return starts.select(key, F.inline(F.filter(block, lambda b: b["kind"] != "blank")))


def report_meta(docs: DataFrame, key: str, text: str = "text", skip_title: str = "report") -> DataFrame:
    """key, title, location, audience: first heading but the default one, else the first short line; the last named places."""
    said = docs.select(key, lines_of(F.col(text)).alias("__lines"))
    said = said.withColumn("__said", F.transform("__lines", lambda x: F.struct(x.alias("line"), plain(x).alias("plain"))))
    heading = F.filter("__said", lambda x: F.startswith(x["line"], F.lit("#")) & (x["plain"] != "") & (F.lower(x["plain"]) != skip_title))
    short = F.filter("__said", lambda x: (x["plain"] != "") & (F.length(x["plain"]) <= 80))

    def named(k: str) -> Column:
        found = F.filter(F.transform("__said", lambda x: F.regexp_extract(x["plain"], f"(?i)^{k}[:\\s]+(.+)$", 1)), lambda x: x != "")
        return F.coalesce(strip(F.try_element_at(found, F.lit(-1))), F.lit(fixed.UNKNOWN)).alias(k)

    title = F.coalesce(F.get(heading, 0)["plain"], F.get(short, 0)["plain"], F.lit(fixed.DEFAULT_TITLE))
    return said.select(key, title.alias("title"), named("location"), named("audience"))


def with_heading(text: Column, title: str) -> Column:
    """The text, under a first-level heading unless it begins with one."""
    t = strip(F.coalesce(text, F.lit("")))
    return F.when(F.startswith(t, F.lit("#")), t).otherwise(F.concat(F.lit(f"# {title}\n\n"), t))


def normal_messages(messages: Column, markers: list[str], welcome: str) -> Column:
    """Messages (role, content) with old welcome texts of the assistant replaced by the current one."""
    def one(m: Column) -> Column:
        old = F.lit(False)
        for x in markers:
            old = old | F.contains(m["content"], F.lit(x))
        return F.when((m["role"] == "assistant") & F.coalesce(old, F.lit(False)), m.withField("content", F.lit(welcome))).otherwise(m)

    return F.transform(messages, one)


def md_table(rows: DataFrame, columns: Mapping[str, str], order: str) -> DataFrame:
    """One row, text: a Markdown table of the rows; columns: heading to column. For registers, whose size is fixed."""
    head = [f"| {' | '.join(columns)} |", "| " + " | ".join("---" for _ in columns) + " |"]
    line = F.struct(F.col(order).alias("o"), row(*(md_value(F.col(c)) for c in columns.values())).alias("line"))
    body = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return rows.agg(F.array_join(F.concat(F.array(*map(F.lit, head)), body), "\n").alias("text"))


def prompt(sections: Mapping[str, Column]) -> Column:
    """Named parts joined into one prompt; blank parts are marked as unknown."""
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"{k}:\n"), blank_to(v, fixed.UNKNOWN)) for k, v in sections.items()))
