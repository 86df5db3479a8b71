"""Main text of web pages by consensus host paths.

Each page's containers are scored by the running text that they hold; the best one votes, with its path of
tags and classes (digits generalised), for its host. Votes are counted in Spark, and every page is read
again by its host's winning path; pages that lack it use their own best container. Hosts with more than one
vote in HOT are broadcast, HOT rows at most; their pages are dealt out evenly when the others meet their host.

A page takes a time in proportion to its length, whatever its markup: elements hold their parents and their own
step of the path, and scores and asides are passed along once, from parents to children or back.

Edge cases: a null or empty html has an empty text; pages without url share one host; unclosed and stray
tags are repaired, never dropped with their text; ties go to the shorter, then lesser path; repeated rows
give repeated results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Elements whose content is no markup.
RAW = "script|style|noscript|template|title|textarea|iframe|xmp|noembed|noframes"
#: No part of it goes back over what it has passed, and a tag ends before the next "<", so that reading takes a time in proportion to the page.
#: Quotes count only where a value begins, as in browsers.
ATTRS = r"(?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^<>])*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>]){ATTRS}>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*+)(?P<attrs>{ATTRS})>|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
ATTR = re.compile(r"([^\s=/]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|(\S+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td".split())
#: Elements that a start tag of the same set closes, and those that it doesn't look beyond.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())
#: Not part of an article: elements, roles, and words in class or id of what holds blocks.
ASIDE_TAGS = frozenset("aside button canvas dialog footer form head header input label menu nav object select svg".split())
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
HOLDERS = BLOCKS - frozenset("article blockquote body dd dt h1 h2 h3 h4 h5 h6 hr html main p pre".split())
ASIDE_WORD = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|alerts?|banners?|breadcrumbs?|byline|comments?|commentlist|consent|cookies?|copyright|disclaimer|disqus|footers?|gdpr|"
    r"headers?|login|masthead|menus?|modal|nav|navbar|navigation|newsletters?|notices?|notifications?|pager|pagination|popups?|promos?|promotion|recommended|"
    r"recommendations?|related|replies|respond|search|searchbar|searchbox|shares?|sharebar|sharing|sidebars?|side|signup|skip|socials?|sponsors?|sponsored|"
    r"subscribe|subscription|tags|teasers?|toolbar|widgets?)\d*",
    re.I,
)
#: Elements within a line of text that such names take out of it, as the others are too common in articles' own links.
LINE_ASIDE, LINE_WORD = frozenset("del ins small span".split()), re.compile(r"(?:ads?|adsby\w+|adv|advert\w*|adsense|sponsor\w*|promos?|promotion)\d*", re.I)
#: Words behind such a word in one name, as in "share-buttons"; and words that say the element only stands beside one.
ASIDE_PART = frozenset("area banner bar block blocks body box button buttons buttonset container content form group holder inner item items link links list outer panel policy posts row section slot unit widget wrap wrapper".split())
BESIDE = frozenset("free has no not with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Hosts that can have so large a share of the votes, one in HOT; and characters of a path that is broadcast.
HOT, HOT_PATH = 2000, 2000


def is_aside(name: str, word: re.Pattern[str] = ASIDE_WORD) -> bool:
    """Whether a class or id names something beside the article: its last word does, or its first one with a general word last."""
    words = [w for w in re.split(r"[-_:]+", name.lower()) if w and not w.isdigit()]
    if not words or BESIDE.intersection(words):
        return False
    return bool(word.fullmatch(words[-1]) or words[-1].rstrip("0123456789") in ASIDE_PART and word.fullmatch(words[0]))


class Page:
    """Elements (parallel lists, parents first) and blocks (text, element, characters within links) of a page, in order."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.step, self.aside = ["html"], [-1], ["html"], [False]
        self.block = [0]  # the nearest block element, itself included
        self.blocks: list[tuple[str, int, int]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        tags, text, links, at, in_link, muted = self.tag, [], 0, 0, 0, 0  # muted: open asides within the line
        # Open elements; how many of each tag there are, at all and since the last one in SCOPE.
        stack, every, frames, scopes = [0], Counter(), [Counter()], ["html"]

        def flush() -> None:
            nonlocal links
            if text:
                block = " ".join("".join(text).split())
                if block:
                    self.blocks.append((block, self.block[stack[-1]], links))
                text.clear()
            links = 0

        def add(part: str) -> None:
            nonlocal links
            if muted:
                return
            part = unescape(part)
            text.append(part)
            if in_link:
                links += len(part.strip())

        def close(tag: str) -> None:
            """Close the nearest open element of this tag, and what is open within it."""
            nonlocal muted
            while True:
                k = stack.pop()
                t = tags[k]
                muted -= self.aside[k] and t not in BLOCKS
                every[t] -= 1
                if t in SCOPE:
                    frames.pop()
                    scopes.pop()
                else:
                    frames[-1][t] -= 1
                if t == tag:
                    return

        for m in TOKEN.finditer(html):
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["raw"]:
                    text.append(" ")
                continue
            tag = tag.lower()
            if m["end"]:
                if tag == "a":
                    in_link = max(0, in_link - 1)
                if tag == "br":
                    text.append(" ")
                if (every if tag in SCOPE else frames[-1])[tag]:
                    k = len(stack) - 1
                    while tags[stack[k]] != tag and tags[stack[k]] not in BLOCKS:
                        k -= 1
                    if tags[stack[k]] in BLOCKS:
                        flush()
                    close(tag)
                elif tag in BLOCKS:
                    flush()
                continue
            if tag in BLOCKS:
                flush()
                in_link = 0
                for t in CLOSES.get(tag, ()):
                    if frames[-1][t] or scopes[-1] == t:
                        close(t)
                if frames[-1]["p"]:
                    close("p")
            if tag in VOID:
                text.append(" ")
                continue
            if tag == "a":
                in_link += 1
            if tag == "html":
                continue
            k = len(tags)
            tags.append(tag)
            self.parent.append(stack[-1])
            self.block.append(k if tag in BLOCKS else self.block[stack[-1]])
            attrs = m["attrs"]
            names, aside = "", tag in ASIDE_TAGS
            if attrs and not attrs.isspace():
                a = {k.lower(): unescape(x or y or z or "") for k, x, y, z in ATTR.findall(attrs)}
                own = a.get("class", "")
                names = " ".join(sorted(re.sub(r"\d+", "#", own.lower()).split()))
                hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
                aside = aside or hidden or a.get("role", "").lower() in ASIDE_ROLES or any(is_aside(x) if tag in HOLDERS else is_aside(x, LINE_WORD) for x in f"{own} {a.get('id', '')}".split() if tag in HOLDERS or tag in LINE_ASIDE)
            self.step.append(f"{tag}.{names}" if names else tag)
            self.aside.append(aside)
            if not attrs.endswith("/") or tag in BLOCKS:
                stack.append(k)
                muted += aside and tag not in BLOCKS
                every[tag] += 1
                if tag in SCOPE:
                    frames.append(Counter())
                    scopes.append(tag)
                else:
                    frames[-1][tag] += 1
        if at < len(html):
            add(html[at:])
        flush()

    def path(self, k: int) -> str:
        steps = []
        while k >= 0:
            steps.append(self.step[k])
            k = self.parent[k]
        return "/".join(reversed(steps))

    def best(self) -> int:
        """The container with the most running text: full marks to the nearest one, half to the next, and so on."""
        n = len(self.tag)
        hidden, container = [False] * n, [-1] * n
        for k in range(n):
            up = self.parent[k]
            hidden[k] = self.aside[k] or up >= 0 and hidden[up]
            container[k] = k if self.tag[k] in CONTAINERS else container[up] if up >= 0 else -1
        score: dict[int, float] = {}
        held = [0] * n  # blocks that are no headings
        for b, k, links in self.blocks:
            if not hidden[k]:
                heading = self.tag[k] in HEADINGS
                held[k] += not heading
                if (c := container[k]) >= 0:
                    score[c] = score.get(c, 0.0) + float(len(b) - 2 * links) * (0.2 if heading else 1)
        for k in range(n - 1, 0, -1):
            up = self.parent[k]
            held[up] += held[k]
            if k in score and (c := container[up]) >= 0:
                score[c] = score.get(c, 0.0) + score[k] / 2
        if not score:
            return 0
        best = max(score, key=lambda x: (score[x], -x))
        x = best
        while x >= 0:
            if self.tag[x] == "article":
                return x
            x = self.parent[x]
        while (up := self.parent[best]) > 0 and self.tag[up] not in ("body", "html") and held[up] == held[best]:
            best = up
        return best

    def text(self, roots: set[int]) -> str:
        """The blocks within the roots, without what doesn't belong to an article."""
        within = [False] * len(self.tag)
        for k, up in enumerate(self.parent):
            within[k] = k in roots or not self.aside[k] and up >= 0 and within[up]
        return "\n\n".join(b for b, k, _ in self.blocks if within[k])

    def at(self, path: str) -> set[int]:
        """The elements of a path."""
        end = [-1] * len(self.tag)  # how much of the path an element's own takes up, if the path begins so
        for k, (up, step) in enumerate(zip(self.parent, self.step)):
            before = "" if up < 0 else "/"
            if (up < 0 or end[up] >= 0) and path.startswith(before + step, 0 if up < 0 else end[up]):
                end[k] = (0 if up < 0 else end[up]) + len(before + step)
        return {k for k, e in enumerate(end) if e == len(path)}

    def main_text(self, path: str | None) -> str:
        own = self.at(path) if path else set()
        own = {k for k in own if not self.aside[k]} or own
        return (self.text(own) if own else "") or self.text({self.best()})


def vote(html: str | None) -> str | None:
    page = Page(html or "")
    return page.path(page.best()) if page.blocks else None


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path (the winner of each host) and votes (of all its paths); columns host and html of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([vote(x.as_py()) for x in b.column(1)], pa.string())], ["host", "path"])

    votes = pages.select("host", "html").mapInArrow(run, "host string, path string").filter("path is not null")
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct("n", -F.length("path"), "path")
    return counted.groupBy("host").agg(F.max_by("path", first).alias("path"), F.sum("n").alias("votes"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    host = ascii_lower(F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("")))
    own = pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))
    paths = cut(host_paths(own))
    total = paths.agg(F.sum("votes")).first()[0] or 0
    hot = paths.filter((F.col("votes") * HOT > total) & (F.length("path") <= HOT_PATH))
    met = own.join(F.broadcast(hot.select("host", F.col("path").alias("hot"))), "host", "left")
    # Pages of hot hosts get keys that no host has.
    spread = F.concat(F.lit("/"), F.xxhash64("page_id", "url").cast("string"))
    keyed = met.withColumn("key", F.when(F.col("hot").isNull(), F.col("host")).otherwise(spread))
    others = paths.select(F.col("host").alias("key"), "path")
    joined = keyed.join(others, "key", "left").select("page_id", "url", "html", F.coalesce("hot", "path").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(h.as_py() or "").main_text(p.as_py()) for h, p in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
