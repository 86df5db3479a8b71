"""Archives and main texts."""

from __future__ import annotations

import base64
import hashlib

import pytest

from terravane.llm import html_extract, warc
from terravane.llm.common import scratch

HTML = ["<p>a</p>", "", None, "<p>a</p>", "WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "line\n\nhttp://x 0.0.0.0 2000 text/html 3\nabc", "é日本\x00", "x" * 100_000]
URLS = ["http://a/b c", None, "", "http://é.org/ü", "http://a/\nb", "u", "u", "u"]


def frame(spark, rows=None):
    rows = list(zip(range(len(HTML)), URLS, HTML)) if rows is None else rows
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, content string, path string")


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    rows = [*zip(range(len(HTML)), URLS, HTML), (9, "u", "<p>a</p>"), (9, "u", "<p>a</p>"), (None, "u", "<p>a</p>"), (None, "u", "alone")]
    got = warc.round_trip(frame(spark, rows), version).collect()
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = max(first.get(h or "", k), k)
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        to = first.get(h or "")
        to = None if to == k else to
        want.append((str(k), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to))
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert all(r.date == "2000-01-01T00:00:00Z" and r.record_id.startswith("<urn:uuid:") for r in got)


def test_versions_are_told_apart():
    body = warc.version_block(2, "n", "20000101000000") + "\n" + warc.arc_record(2, "http://a", "20000101000000", "HTTP/1.1 200 OK\r\n\r\né\n\nx", "n") + "\n"
    body += warc.version_block(1, "n", "20000101000000") + "\n" + warc.arc_record(1, "http://b", "20010101000000", "y", "n") + "\n"
    a, b = warc.arc_records(body.encode())
    assert (a.url, a.content, b.url, b.date) == ("http://a", "HTTP/1.1 200 OK\r\n\r\né\n\nx".encode(), "http://b", "20010101000000")


@pytest.mark.parametrize("bad", [b"http://a 0 0 0 9\nshort\n", b"http://a 0 9\nx", b"no line", b"filedesc://x 0 0 0 8\n7 0 x\nURL\n"])
def test_damaged_archives(bad):
    with pytest.raises(ValueError):
        list(warc.arc_records(bad))


def test_empty_archive(spark):
    assert warc.round_trip(frame(spark).limit(0)).collect() == []
    where = scratch(spark, "arc")
    warc.write_arc(frame(spark), where)
    assert spark.read.format("binaryFile").load(where).count() >= 1


PAGE = """<html><body class="home"><header><h1>Site</h1></header><div id="cookie-notice">We use</div><nav><ul><li>Menu<li>Two</ul></nav>
<div class="wrap-7"><aside>links</aside><div class="post-12 body"><h2>Title</h2><p>One &amp; two&nbsp;three &lt;b&gt; long text here for scoring, yes <a href=x>link</a> more.<p>Second<br>para <b>bold<p>third</b></p>
<!-- hidden --><script>var x = "</p>";</script><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><div class="ad-box">buy</div><form>x<input></form><blockquote>Quote</blockquote></div>
<section id="comments"><p>nice post by a reader with a very very long comment text that goes on</p></section></div><footer>&copy; f</footer></body></html>"""
TEXT = "Title\n\nOne & two three <b> long text here for scoring, yes link more.\n\nSecond para bold\n\nthird\n\na\n\nb\n\n1\n\n2\n\n3\n\nQuote"


def test_main_text():
    page = html_extract.Page(PAGE)
    assert page.main_text(None) == TEXT
    assert page.main_text("html/no/such/path") == TEXT


def test_template_articles(spark):
    """Against the articles of the test pages, cut out by their tags."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_extract.main_texts(pages).collect()}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<(?!/?(?:p|h1)\\b)[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)\\b[^>]*>", inner))
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id] == (r.url, want, len(want))


def test_host_votes_decide(spark):
    usual = "<body><div class='story 1'><p>{}</p></div><div class='extra'><p>{}</p></div></body>"
    rows = [(k, f"http://H.example/{k}", usual.format("main text of the story goes here " * 9, "less")) for k in range(5)]
    rows.append((9, "http://h.example/9", usual.format("the short story", "an extra that is far longer than the story of this page " * 9)))
    rows += [(10, None, None), (11, "", ""), (None, "http://h.example/x", "plain words only"), (12, "http://z/", "<p>alone")]
    got = {r.page_id: r.text for r in html_extract.main_texts(frame(spark, rows)).collect()}
    assert got[9] == "the short story" and got[10] == "" and got[11] == "" and got[None] == "plain words only" and got[12] == "alone"


def test_no_pages(spark):
    assert html_extract.main_texts(frame(spark).limit(0)).collect() == []


def test_deep_and_broken_markup():
    assert html_extract.Page("<div>" * 500 + "deep" + "</p></span>" * 10).main_text(None) == "deep"
    assert html_extract.Page("a < b <3 & c &amp d <").main_text(None) == "a < b <3 & c & d <"


@pytest.mark.parametrize(
    ("name", "aside"),
    [("ad", True), ("ad-box", True), ("ads2", True), ("site-header", True), ("share-buttons", True), ("cookie_notice", True), ("comments", True), ("comment-list", True), ("related-posts", True), ("sidebar-12", True),
     ("share-prices", False), ("comment-free", False), ("no-sidebar", False), ("with-sidebar", False), ("post", False), ("adventure", False), ("search-results", False), ("main-content", False), ("12", False), ("", False)],
)
def test_names_of_what_stands_beside(name, aside):
    assert html_extract.is_aside(name) == aside


def test_article_text_with_such_names_stays():
    page = html_extract.Page("<article><p>First.</p><p id='share-prices'>Share prices rose.</p><div class='comment-free'>Quiet.</div><p class='ad'>Still prose.</p><div class='share'>Tell</div></article>")
    assert page.main_text(None) == "First.\n\nShare prices rose.\n\nQuiet.\n\nStill prose."


BODY = "".join(f"<p>Paragraph {k} says something of a fair length, with commas, and more.</p>" for k in range(4))
WANTED = "\n\n".join(f"Paragraph {k} says something of a fair length, with commas, and more." for k in range(4))
TEMPLATES = [
    "<div id=page><div class='site-header'>Name</div><div class='no-sidebar'><div class='entry'>{}</div></div><div class='widget-area'><ul><li>x</ul></div></div>",
    "<table><tr><td class=left><a href=a>One</a><br><a href=b>Two</a></td><td>{}</td></tr></table><div class=copyright>c</div>",
    "<main>{}<section class='related-posts'><p>Another story that one might read some other time, with a long teaser.</p></section></main><div role=contentinfo>x</div>",
    "<section><div><div>{}</div></div></section><section id=comments><div><p>A reader has much to say, and says it here at length, again and again, on and on.</p></div></section>",
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_templates_without_article(spark, template):
    page = html_extract.Page(f"<html><body>{template.format(BODY)}</body></html>")
    assert page.main_text(None) == WANTED
    assert page.main_text(page.path(page.best())) == WANTED
    rows = [(k, "http://h/x", f"<html><body>{template.format(BODY)}</body></html>") for k in range(5)]
    assert {r.text for r in html_extract.main_texts(frame(spark, rows)).collect()} == {WANTED}


HOSTILE = ["<a ", "<div>w ", "<span class=x>", "<a<", '<a "', "<h1>x", "<p><span>", "</div></b>", "<b>x", "<table><tr><td>x", "<li>x", "<!-", "<a '\"", "&amp", "<script", "<ul><li><p>x", "<x y='", "</", "<"]


@pytest.mark.parametrize("markup", HOSTILE)
def test_hostile_markup_takes_time_in_proportion(markup):
    import time

    def seconds(size):
        began = time.process_time()
        page = html_extract.Page(markup * (size // len(markup)))
        page.main_text(page.path(page.best()))
        return time.process_time() - began

    assert seconds(1 << 20) < 40 * max(seconds(1 << 16), 0.05)  # 16 times the length


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<p title=don't>First.</p>", "First."),
        ("<p title=\"a>b\" x='<p>' y = \"it's\">First <a href=x/>one</a>.</p>", "First one."),
        ("<p>Text <span hidden>secret</span> <span style='display:none'>x1</span> <span class='ad'>AD</span><label>Name</label><svg><text>v</text></svg> end.</p><button>Buy</button>", "Text end."),
        ("<p>A <span class='ad-slot'>buy <b>now</b></span>story <ins class=adsbygoogle>x</ins><span class=lead>goes on</span>.</p>", "A story goes on."),
        ("<p>One <span aria-hidden=true>two</p><p>three.</p>", "One\n\nthree."),
    ],
)
def test_asides_within_a_line_and_odd_attributes(inside, text):
    page = html_extract.Page(f"<body><article>{inside}<p>Then a second paragraph of the story.</p></article></body>")
    assert page.main_text(None) == f"{text}\n\nThen a second paragraph of the story."


def test_unclosed_tags_keep_their_text():
    assert html_extract.Page("<p>a < b and c <d <p>next").main_text(None) == "a < b and c <d\n\nnext"
    assert html_extract.Page("<table><tr><td><b>1<tr><td>2<dl><dt>t<dd>d<dt>u</dl>").text({0}).split("\n\n") == ["1", "2", "t", "d", "u"]


def test_archives_are_bounded_and_streamed(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 7)
    rows = [(k, f"http://h/{k}", "x" * (k * 37 % 5000)) for k in range(60)]
    df = frame(spark, rows).coalesce(1)
    arc, to = scratch(spark, "arc"), scratch(spark, "warc")
    warc.write_arc(df, arc, 2)
    each = [len(list(warc.arc_records(r.content))) for r in warc.archives(spark, arc).collect()]
    assert sum(each) == 60 and max(each) <= 6 and len(each) == 10  # a version block opens each
    warc.convert(spark, arc, to)
    assert max(len(list(warc.warc_records(r.content))) for r in warc.archives(spark, to).collect()) <= 7
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_warc(spark, to).collect()) == [(k, len(h)) for k, _, h in rows]


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_inflating_by_pieces(monkeypatch, piece):
    import gzip

    monkeypatch.setattr(warc, "PIECE", piece)
    body = warc.version_block(2, "n", "20000101000000") + "\n" + "".join(warc.arc_record(2, f"http://a/{k}", "20000101000000", "y\n" * k, "n") + "\n" for k in range(30))
    want = [(f"http://a/{k}", b"y\n" * k) for k in range(30)]
    raw = body.encode()
    for b in (raw, gzip.compress(raw), b"".join(gzip.compress(raw[k : k + 100]) for k in range(0, len(raw), 100))):
        assert [(r.url, r.content) for r in warc.arc_records(b)] == want
    with pytest.raises(ValueError):
        list(warc.arc_records(gzip.compress(raw)[:-20]))
