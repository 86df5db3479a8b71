"""URL filters: written rules first, then the host's reputation by empirical Bayes.

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. At each level a
beta-binomial prior, centred on the level above, shrinks the observed rate; its strength is estimated
from all groups of the level by the method of moments. A host is blocked if the lower bound of its
posterior bad rate exceeds a limit.

Edge cases: a null url, or one without "://", has an empty host and path and the reputation of the empty
host; pages without label and labels without page count for nothing; a page labelled twice takes its
worst label; without any label everything unruled is allowed; repeated rows give repeated results;
further columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Suffixes of more than one label under which names are registered, for use without a list of one's own (see read_suffixes).
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "org.au", "net.au", "gov.au", "edu.au", "co.nz", "co.jp")
#: Rules become one CASE expression each and suffixes one set each for their numbers of labels, so both are bounded.
MOST_RULES, MOST_SUFFIXES = 256, 50_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    found = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def read_suffixes(spark: SparkSession, path: str) -> list[str]:
    """Suffixes of more than one label from a text file, one to a line; blank lines, comments (//) and patterns are passed over."""
    line = F.lower(F.trim("value"))
    kept = spark.read.text(path).select(line.alias("x")).filter("x <> '' and x not like '//%' and x like '%.%' and x not like '%*%' and x not like '!%'")
    found = [r.x for r in kept.distinct().limit(MOST_SUFFIXES + 1).collect()]
    if len(found) > MOST_SUFFIXES:
        raise ValueError(f"more than {MOST_SUFFIXES} suffixes")
    return sorted(found)


def suffix_and_domain(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """Of a host, without user and port: its suffix, and the domain registered under it; both are an IP address itself."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    suffix, domain = F.substring_index(name, ".", -1), F.substring_index(name, ".", -2)
    for n in sorted({x.count(".") + 1 for x in long_suffixes}):  # the longest one last, so that it counts
        last = F.substring_index(name, ".", -n)
        found = last.isin([x for x in long_suffixes if x.count(".") + 1 == n])
        suffix, domain = F.when(found, last).otherwise(suffix), F.when(found, F.substring_index(name, ".", -n - 1)).otherwise(domain)
    address = name.rlike("^([0-9]{1,3}(\\.[0-9]{1,3}){3}|\\[.*\\])$")
    return F.when(address, name).otherwise(suffix), F.when(address, name).otherwise(domain)


def strength(groups: DataFrame) -> float:
    """Prior observations at a level, from columns n, bad and m (the prior mean), by the method of moments."""
    n, m = F.col("n"), F.col("m")
    spread = m * (1 - m)
    row = groups.agg(
        F.sum((F.col("bad") - n * m) ** 2 - n * spread).alias("over"), F.sum(n * (n - 1) * spread).alias("all")
    ).first()
    rho = min(max((row["over"] or 0.0) / row["all"], 1e-4), 0.99) if row["all"] else 1e-4
    return 1 / rho - 1


def reputation(labelled: DataFrame, z: float = 1.645, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """host, n, bad, rate and bound from rows (host, bad): bad is 0, 1 or null where the page has no label.

    Every host of the input has a row, labelled or not.
    """
    suffix, domain = suffix_and_domain(F.col("host"), long_suffixes)
    hosts = cut(
        labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"suffix": suffix, "domain": domain})
    )
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    level = level.withColumn("m", F.lit((total["bad"] or 0) / max(total["n"] or 0, 1)))
    k = strength(level)
    rate = lambda k: (F.col("bad") + k * F.col("m")) / (F.col("n") + k)
    above = level.select("suffix", rate(k).alias("m"))
    level = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(above, "suffix")
    k = strength(level)
    above = level.select("domain", rate(k).alias("m"))
    level = hosts.join(above, "domain")
    k = strength(level)
    mean = rate(k)
    deviation = F.sqrt(mean * (1 - mean) / (F.col("n") + k + 1))
    return level.select("host", "n", "bad", mean.alias("rate"), F.greatest(mean - z * deviation, F.lit(0.0)).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], limit: float = 0.5, z: float = 1.645, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, rate and bound of every page; outcomes: (page_id, bad)."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    worst = outcomes.filter("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = reputation(parts.join(worst, "page_id", "left").select("host", "bad"), z, long_suffixes)
    found = ruled(F.col("host"), F.col("path"), rules)
    joined = parts.withColumn("found", found).join(hosts.select("host", "rate", "bound"), "host", "left")
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "rate", "bound")
