"""Scalar column builders with the engine's rules for blanks, numbers and keywords."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terravane import fixed


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes spaces only)."""
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, "(?U)\\s+$", "")


def lstrip(x: Column) -> Column:
    return F.regexp_replace(x, "(?U)^\\s+", "")


def blank_to(x: Column, default: Column | str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default) if isinstance(default, str) else default)


def count_of(x: Column) -> Column:
    """A count from text: blank or unreadable is 0, decimals are cut."""
    return F.coalesce(x.try_cast("double").cast("long"), F.lit(0))


def number_of(x: Column) -> Column:
    """A number from text; blank or unreadable is 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def rounded(x: Column, places: int) -> Column:
    """x >= 0 rounded on its binary value, ties to even; round() would first take the shortest decimal."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places)).cast("double")


def ratio_pct(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, null where the whole is zero."""
    return rounded(F.try_divide(part, whole) * 100, 1)


def support_band(pct: Column, population: Column | None = None) -> Column:
    """high, medium or low by the rounded percentage; unknown without population."""
    band = F.lit("low")
    for name, limit in reversed(fixed.SUPPORT_BANDS):
        band = F.when(pct >= limit, name).otherwise(band)
    known = pct.isNotNull() if population is None else (F.coalesce(population, F.lit(0)) != 0)
    return F.when(known, band).otherwise("unknown")


def slug(x: Column, most: int = 80, default: str = "unknown") -> Column:
    """Lower case, other characters collapsed to one underscore; cut after the underscores are trimmed."""
    s = F.regexp_replace(F.lower(x), "[^\\p{L}\\p{N}]+", "_")
    return blank_to(F.left(F.regexp_replace(s, "^_+|_+$", ""), F.lit(most)), default)


def file_slug(x: Column) -> Column:
    """Case kept, one underscore for each other character."""
    return F.regexp_replace(F.regexp_replace(x, "[^\\p{L}\\p{N}]", "_"), "^_+|_+$", "")


def md_value(x: Column) -> Column:
    """A Markdown table cell."""
    return strip(F.replace(F.replace(blank_to(x.cast("string"), fixed.UNKNOWN), F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" ")))


def with_unit(x: Column, unit: str) -> Column:
    text = F.nullif(x.cast("string"), F.lit(""))
    return F.when(text.isNull(), "").otherwise(F.concat_ws(" ", text, F.lit(unit)))


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def url_query(parameters: Mapping[str, Column]) -> Column:
    return F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in parameters.items()))


def quoted_in_list(names: Column) -> Column:
    """SQL list of quoted names, quotes doubled, for a remote predicate."""
    return F.concat(F.lit("("), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), F.replace(n, F.lit("'"), F.lit("''")), F.lit("'"))), ","), F.lit(")"))


def column_index(ref: Column) -> Column:
    """Zero-based column of a spreadsheet reference such as AB12."""
    letters = F.split(F.regexp_replace(F.upper(ref), "[^A-Z]", ""), "")
    return F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def header_name(x: Column) -> Column:
    return F.lower(F.regexp_replace(strip(x), "(?U)\\s+", "_"))


def palette(index: Column, colours: Sequence[Sequence[int]]) -> Column:
    return F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in colours)), (F.pmod(index, F.lit(len(colours))) + 1).cast("int"))


def any_contains(text: Column, terms: Sequence[str]) -> Column:
    """Is any of the terms in the text; a blank term never is. text is in lower case."""
    found = F.lit(False)
    for t in terms:
        if t:
            found = found | F.contains(text, F.lit(t.lower()))
    return F.coalesce(found, F.lit(False))


def all_contained(text: Column, terms: Sequence[str]) -> Column:
    found = F.lit(True)
    for t in terms:
        found = found & F.contains(text, F.lit(t.lower()))
    return found


def terms_found(text: Column, terms: Sequence[str]) -> Column:
    return sum((F.contains(text, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))


def missing_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms that are not in the lower-case text, in their order."""
    return F.array_compact(F.array(*(F.when(~F.contains(text, F.lit(t.lower())), t) for t in terms)))


def has_keyword(text: Column, keyword: Column | str, mode: str = "boundary") -> Column:
    """Is a keyword in the lower-case text; in mode "boundary" one of up to three letters must stand alone."""
    k = F.lit(keyword) if isinstance(keyword, str) else keyword
    plain = F.contains(text, k) & (k != "")
    if mode == "substring":
        return plain
    alone = F.regexp_like(text, F.concat(F.lit("(?<![a-z])\\Q"), k, F.lit("\\E(?![a-z])")))
    return F.when(F.length(k) <= 3, alone & (k != "")).otherwise(plain)


def overlaps(a: Column, b: Column) -> Column:
    """Does one text contain the other; blanks match nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def ordered_distinct(*arrays: Column) -> Column:
    """Union of lists, first occurrences in order, without blanks and nulls."""
    return F.filter(F.array_distinct(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays))), lambda x: x.isNotNull() & (x != ""))


def first_error(*tests: tuple[Column, Column | str]) -> Column:
    """The message of the first test that holds, or null."""
    return F.coalesce(*(F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in tests))


def status_message(code: Column) -> Column:
    """What an HTTP status says of an official entry point."""
    # Messages by status.
    return (
        F.when(code.between(200, 299), "Official entry point responded successfully.")
        .when(code.between(300, 399), "Official entry point redirected successfully.")
        .when(code.isin(401, 403), "Official site is reachable but rejected this automated check.")
        .when(code == 404, "Configured page was not found. Verify the URL.")
        .when(code >= 500, "Official site returned a server-side error during this check.")
        .otherwise("Official entry point responded, but the status should be reviewed.")
    )


def elapsed_ms(started: Column, ended: Column) -> Column:
    """Whole milliseconds between two timestamps; null if either is missing."""
    return F.floor((F.unix_micros(ended) - F.unix_micros(started)) / 1000)


def probe_status(url: Column, code: Column, error: Column) -> Column:
    return F.when(blank_to(url, "") == "", "Missing URL").when(error.isNotNull(), "Check failed").when(code.isNull(), "Not checked").when(code.between(200, 399), "Reachable").otherwise("Check warning")
