"""The queries opN_<name> and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, filter_audit, html_extract, jaccard_join, media, packing, quality_rules, simhash, spelling, suffix_dedup, token_counts, url_filters, warc
from .common import table

#: The rules of op10, fixed by its contract.
URL_RULES = (
    url_filters.Rule("block", "com", "/en/"),
    url_filters.Rule("allow", "example.com", "/en/7"),
    url_filters.Rule("allow", "net", "/de/"),
    url_filters.Rule("block", "example.net", "/de/8"),
    url_filters.Rule("block", "org", "/es/"),
)


#: The document that a page shows, by its url.
DOCUMENT = "^[^:]*://[^/]*/[a-z]+/([0-9]+)"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.digest(table(spark, sf_dir, "documents"), threshold=100)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"), version=2)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_features(table(spark, sf_dir, "documents"), width=64)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = simhash.classes(table(spark, sf_dir, "documents"))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=0)
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels of the document whose number a page's path begins with (/en/685); toxic or of low quality is bad."""
    pages = table(spark, sf_dir, "pages")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labels = table(spark, sf_dir, "labels").filter("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    shown = pages.select("page_id", F.regexp_extract("url", DOCUMENT, 1).try_cast("long").alias("doc_id"))
    judged = url_filters.judge(pages, shown.join(labels, "doc_id").select("page_id", "bad"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_audit.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(judged, list("ABCDE"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), every=199))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"), width=5, percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_warc": op3_warc,
    "op4_media": op4_media,
    "op5_html_extract": op5_html_extract,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_url_filters": op10_url_filters,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling": op12_spelling,
    "op13_jaccard_join": op13_jaccard_join,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BITS = " + ".join(f"{16 >> k} * CAST(substr(bits, CAST(5 * i + {k + 1} AS BIGINT), 1) AS INTEGER)" for k in range(5))
_FITS = " UNION ALL ".join(
    f"SELECT page_id, '{r.host + r.path}' AS rule, '{r.verdict}' AS verdict FROM parts WHERE (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in URL_RULES
)
_LONG = ", ".join(f"'{x}'" for x in url_filters.LONG_SUFFIXES)


def _level(key: str, above: str) -> str:
    """CTEs of one level: its groups with the prior mean above, the prior's strength k, and the shrunk rates."""
    return f"""{key}_g AS (SELECT {key} AS name, sum(n) AS n, sum(bad) AS bad, any_value({above}) AS m FROM {key}_in GROUP BY {key}),
    {key}_k AS (SELECT coalesce(1 / least(greatest(sum((bad - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 1e-4), 0.99), 1e4) - 1 AS k FROM {key}_g),
    {key}_r AS (SELECT name, (bad + k * m) / (n + k) AS rate, n + k AS size FROM {key}_g, {key}_k)"""


ORACLE: dict[str, str] = {
    "op3_warc": f"""WITH d AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS bits FROM pages)
    SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM d""",
    "op10_url_filters": f"""WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    ruled AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM ({_FITS}) GROUP BY page_id),
    label AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    outcome AS (SELECT page_id, max(bad) AS bad FROM pages JOIN label ON doc_id = TRY_CAST(regexp_extract(url, '{DOCUMENT}', 1) AS BIGINT) WHERE page_id IS NOT NULL GROUP BY page_id),
    hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM parts LEFT JOIN outcome USING (page_id) GROUP BY host),
    split AS (SELECT *, split_part(name, '.', -1) AS last, array_to_string(string_split(name, '.')[-2:], '.') AS two, array_to_string(string_split(name, '.')[-3:], '.') AS three, regexp_matches(name, '^([0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}|\\[.*\\])$') AS ip FROM hosts),
    named AS (SELECT host, n, bad, CASE WHEN ip THEN name WHEN two IN ({_LONG}) THEN two ELSE last END AS suffix, CASE WHEN ip THEN name WHEN two IN ({_LONG}) THEN three ELSE two END AS domain FROM split),
    suffix_in AS (SELECT *, (SELECT coalesce(sum(bad), 0) / greatest(coalesce(sum(n), 0), 1) FROM named) AS above FROM named), {_level("suffix", "above")},
    domain_in AS (SELECT named.*, rate AS above FROM named JOIN suffix_r ON suffix = name), {_level("domain", "above")},
    host_in AS (SELECT named.*, rate AS above FROM named JOIN domain_r ON domain = name), {_level("host", "above")}
    SELECT parts.page_id, host, path, rule, coalesce(ruled.verdict, CASE WHEN greatest(rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1)), 0) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts LEFT JOIN ruled USING (page_id) LEFT JOIN host_r ON host = name""",
    "op11_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
    f AS (SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
        || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails FROM d),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o),
    g AS (SELECT part, fails, n, good, toxic, o, CASE WHEN fails = '' THEN 6 ELSE list_min(list_transform(string_split(fails, ''), lambda y: instr(o, y))) END AS gone FROM c, o),
    r AS (SELECT part, o, s.step, substr(o, s.step, 1) AS name, sum(CASE WHEN gone > s.step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = s.step THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone < s.step AND contains(fails, substr(o, s.step, 1)) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = substr(o, s.step, 1) THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN gone = s.step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = s.step THEN toxic ELSE 0 END) AS toxic_lost FROM g JOIN s USING (o) GROUP BY part, o, s.step)
    SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, name) AS BIGINT) AS shapley FROM r""",
}
