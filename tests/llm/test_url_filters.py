from __future__ import annotations

from collections import defaultdict
from math import sqrt

from pyspark.sql import functions as F

from terravane.llm import url_filters
from terravane.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http://Example.COM/en/7x", "https://a.b.example.com/en/", "http://example.net/de/8", "http://x.net/de/8", "http://example.org?x=/es/", "http://example.org/es/#y?z",
    "http://notexample.com/en/7", "ftp://ÄB.com/en/é", "a://b://c/d", "http://com/en/", "http://host/en/\n/x?q", "http://x.org#/es/",
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = rest[:end], rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def frame(spark, urls):
    return spark.createDataFrame([(k, u, "x", "x", "x") for k, u in urls], "page_id long, url string, host string, path string, verdict string")


def test_parts_and_rules(spark):
    pages = frame(spark, [*enumerate(URLS), (None, URLS[4]), (3, URLS[3])])
    none = spark.createDataFrame([], "page_id long, bad int")
    rows = url_filters.judge(pages, none, URL_RULES).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        if r.page_id is None:
            continue
        host, path = plain(URLS[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule.host + rule.path, rule.verdict if rule else "allow")


def plain_reputation(rows, z=1.645):
    hosts = defaultdict(lambda: [0, 0])
    for h, bad in rows:
        hosts[h]
        if bad is not None:
            hosts[h][0] += 1
            hosts[h][1] += bad
    suffix, domain = (lambda h: h.split(".")[-1]), (lambda h: ".".join(h.split(".")[-2:]))
    m0 = sum(b for _, b in hosts.values()) / max(1, sum(n for n, _ in hosts.values()))

    def level(key, above):
        g = defaultdict(lambda: [0, 0, 0.0])
        for h, (n, b) in hosts.items():
            x = g[key(h)]
            x[0] += n
            x[1] += b
            x[2] = above(h)
        all_ = sum(n * (n - 1) * m * (1 - m) for n, _, m in g.values())
        over = sum((b - n * m) ** 2 - n * m * (1 - m) for n, b, m in g.values())
        k = 1 / (min(max(over / all_, 1e-4), 0.99) if all_ else 1e-4) - 1
        return {x: ((b + k * m) / (n + k), n, k) for x, (n, b, m) in g.items()}

    s = level(suffix, lambda h: m0)
    d = level(domain, lambda h: s[suffix(h)][0])
    out = level(lambda h: h, lambda h: d[domain(h)][0])
    return {h: (m, max(0.0, m - z * sqrt(m * (1 - m) / (n + k + 1)))) for h, (m, n, k) in out.items()}


def test_reputation(spark):
    rows = [("bad.example.com", 1)] * 30 + [("bad.example.com", 0)] * 2 + [("good.example.com", 0)] * 40 + [("a.example.org", 0)] * 9 + [("a.example.org", 1)] + [("new.example.com", None), ("", None), ("b.other.org", 1)]
    got = {r.host: (r.rate, r.bound) for r in url_filters.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    want = plain_reputation(rows)
    assert got.keys() == want.keys()
    for h in want:
        assert abs(got[h][0] - want[h][0]) < 1e-9 and abs(got[h][1] - want[h][1]) < 1e-9
    assert got["bad.example.com"][1] > 0.5 > got["new.example.com"][1]
    assert got["bad.example.com"][0] > got["new.example.com"][0] > got["good.example.com"][0]


def test_bad_hosts_are_blocked(spark):
    pages = frame(spark, [(k, f"http://{'bad' if k < 60 else 'good'}.example.com/fr/{k}") for k in range(120)])
    outcomes = spark.createDataFrame([(k, int(k < 60)) for k in range(0, 120, 2)] + [(None, 1)], "page_id long, bad int")
    rows = url_filters.judge(pages, outcomes, URL_RULES).collect()
    assert all((r.verdict == "block") == (r.page_id < 60) for r in rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, bad int")
    assert url_filters.judge(frame(spark, [(1, "x")]).limit(0), none, URL_RULES).collect() == []


def test_suffixes_and_domains(spark, tmp_path):
    (tmp_path / "suffixes.txt").write_text("// a list\ncom\nco.uk\n\nsch.co.uk\n*.ck\n!www.ck\nexample.com.au\n")
    suffixes = url_filters.read_suffixes(spark, str(tmp_path / "suffixes.txt"))
    assert suffixes == ["co.uk", "example.com.au", "sch.co.uk"]
    want = {
        "a.b.com": ("com", "b.com"), "b.com:8080": ("com", "b.com"), "u:p@a.b.com:80": ("com", "b.com"), "x.y.co.uk": ("co.uk", "y.co.uk"), "x.y.sch.co.uk": ("sch.co.uk", "y.sch.co.uk"),
        "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:81": ("10.0.0.1", "10.0.0.1"), "[::1]:8": ("[::1]", "[::1]"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r.host: (r.s, r.d) for r in df.select("host", *(c.alias(k) for c, k in zip(url_filters.suffix_and_domain(F.col("host"), suffixes), "sd"))).collect()} == want


def test_pages_labelled_twice_take_the_worst(spark):
    pages = frame(spark, [(k, f"http://h{k % 2}.com/{k}") for k in range(40)] + [(None, "http://h0.com/")])
    once = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(40)], "page_id long, bad int")
    twice = once.unionByName(once.withColumn("bad", F.lit(0))).unionByName(spark.createDataFrame([(None, 1), (99, 1)], "page_id long, bad int"))
    a, b = (sorted((str(r.page_id), r.host, r.verdict, round(r.bound, 9)) for r in url_filters.judge(pages, x, URL_RULES).collect()) for x in (once, twice))
    assert a == b and {v for _, h, v, _ in a if h == "h0.com"} == {"block"} and {v for _, h, v, _ in a if h == "h1.com"} == {"allow"}
