"""Main text of HTML pages from streamed parser events and smoothed text-to-tag ratios.

A page goes through the standard library's parser in chunks; its events make lines, one for each block of text (a
paragraph, heading, list item, cell...), whatever the line feeds of the source. A line's text-to-tag ratio is its characters over its
tags. The ratios in page order are smoothed by a Gaussian (RADIUS lines to each side, deviation SIGMA); a
line is content if its smoothed ratio reaches the threshold, the standard deviation of the page's smoothed ratios.

The content lines select a region: from the page's root down, into the child element that holds most of their text, as long
as no line with a high ratio of its own is left outside (an `article` or `main` is entered with half of the text already). A page
title (h1) before the region belongs to it. All lines of the region are its text, short ones too; outside of
`article` and `main` its edges lose bare lines with low ratios, and lists that are links only are menus.

Lines of these elements never count, wherever they are: DROPPED (scripts, forms' controls and the like), BOILERPLATE
elements and roles (a header only outside of an article), hidden elements, and elements whose class or id has a word of CUES. A form,
or an element marked by a cue other than those of COMMENTS, that holds the page's article, or most of its text and no article or h1 is
outside of it, is a wrapper and counts.

Texts: character references decoded, runs of white space (of Unicode, no-break spaces too) are one space, blocks joined by line
feeds. Defined results: a null or empty page, or one without content, has an empty text and n_chars 0. Rows are judged
one by one, repeated ones too; an empty table gives an empty one. Further columns, whatever their names, pass through
`extract` (one named like a made column is replaced). One narrow pass; memory is that of a batch of pages.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import col, give_back, small_batches, table

RADIUS, SIGMA = 2, 1.0
CHUNK = 1 << 16
MOST = 0.75
MENU_LINKS = 3
#: Elements nested deeper aren't opened; their text is that of the element around.
MAX_DEPTH = 400

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "script search section select style summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Block elements that hold text and not other parts of a page.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption caption summary address legend".split())
DROPPED = frozenset("applet audio button canvas dialog embed head iframe input map math noscript object optgroup option script select style svg template textarea title video".split()) - {"math"}
BOILERPLATE = frozenset("nav footer aside menu search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())

#: Words of a class or id that mark an element as no part of the main text.
COMMENTS = frozenset("comment comments commentlist disqus replies respond responses discussion".split())
CUES = COMMENTS | frozenset(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline-share consent cookie cookies copyright crumbs disclaimer dropdown footer gdpr legal login masthead menu modal nav navbar "
    "navigation newsletter notice notification overlay pager pagination popup promo promotion promotions recommendations recommended related search share sharing sidebar signup skip social sponsor sponsored "
    "sponsors subscribe subscription toolbar widget widgets".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NOT = re.compile(r"(?i)(?:no|not|has|with|without|hide|is)[-_]")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def cues(value: str) -> set[str]:
    """The words of CUES in a class or id; names that begin with has-, no- and the like say nothing of the element itself."""
    return {w for name in value.split() if not _NOT.match(name) for w in map(str.lower, _WORDS.findall(name)) if w in CUES or w == "header"}


class Lines(HTMLParser):
    """The lines of a page, and its elements as a list of nodes (parents before children)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.flag = ["#page"], [-1], [""]
        self.open = [0]
        self.lines: list[tuple[int, str, int, int]] = []  # node, text, tags, characters within links
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.dropped = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            block = next(n for n in reversed(self.open) if self.tag[n] in BLOCKS or not n)
            self.lines.append((block, text, max(1, self.tags), min(self.linked, len(text))))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def _pop(self, depth: int) -> None:
        """Close the open elements from depth on."""
        if any(self.tag[n] in BLOCKS for n in self.open[depth:]):
            self.flush()
        for n in self.open[depth:]:
            self.links -= self.tag[n] == "a"
            self.dropped -= self.flag[n] == "dropped"
        del self.open[depth:]

    def _depth(self, names: frozenset[str] | set[str], until: frozenset[str] | set[str] = frozenset()) -> int:
        """Where the innermost open element of these names is, if none of `until` is above it; 0: nowhere."""
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in names:
                return depth
            if tag in until:
                return 0
        return 0

    def _implied(self, tag: str) -> None:
        """End tags that a start tag stands for."""
        if tag not in HEAD_ONLY and tag not in ("html", "head") and (at := self._depth({"head"})):
            self._pop(at)
        if tag in BLOCKS and tag not in HEAD_ONLY and (at := self._depth({"p", "h1", "h2", "h3", "h4", "h5", "h6", "title", "option"}, {"table", "li", "blockquote", "button"})):
            self._pop(at)
        if tag == "a" and (at := self._depth({"a"}, BLOCKS)):
            self._pop(at)
        for own, around in (({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"td", "th"}, {"table"}), ({"tr"}, {"table"})):
            if (tag in own or tag == "tr" and "td" in own) and (at := self._depth(own, around)):
                self._pop(at)
        if tag in ("article", "main") and (at := self._depth({"nav", "select", "button", "noscript", "textarea"})):
            self._pop(at)

    def _flag(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        told = {k: v or "" for k, v in attrs}
        if tag in DROPPED or "hidden" in told or told.get("aria-hidden") == "true" or _NONE.search(told.get("style", "")):
            return "dropped"
        if tag in ("html", "body", "main", "#page"):
            return ""
        inside = bool(self._depth({"article", "main"}))
        if tag in BOILERPLATE or tag == "header" and not inside or ROLES.intersection(told.get("role", "").lower().split()) - ({"form"} if tag == "form" else set()):
            return "boilerplate"
        if tag == "form":
            return "form"
        if tag in BLOCKS or tag in ("span", "a"):
            found = cues(told.get("class", "")) | cues(told.get("id", ""))
            if "header" in found and inside:
                found.discard("header")
            if found & COMMENTS:
                return "comments"
            if found and not (tag == "article" and not found & {"ad", "ads", "advert", "sponsored", "promo", "related"}):
                return "cue" if tag in BLOCKS else ""
        return ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._implied(tag)
        if tag in BLOCKS:
            self.flush()
        elif tag in ("br", "img"):
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID or len(self.open) > MAX_DEPTH:
            return
        flag = self._flag(tag, attrs)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.flag.append(flag)
        self.open.append(len(self.tag) - 1)
        self.links += tag == "a"
        self.dropped += flag == "dropped"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "iframe", "svg"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if at := self._depth({tag}, {"td", "th"} if tag not in ("table", "tr", "tbody", "body", "html", "td", "th", "article", "main") else frozenset()):
            self._pop(at)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))


def lines_of(html: str) -> Lines:
    page = Lines()
    for at in range(0, len(html), CHUNK):
        page.feed(html[at : at + CHUNK])
    page.close()
    page.flush()
    return page


def smoothed(ratios: list[float]) -> list[float]:
    """The ratios under a Gaussian; at the page's ends over the lines that are there."""
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        near = range(max(0, i - RADIUS), min(len(ratios), i + RADIUS + 1))
        out.append(sum(kernel[j - i + RADIUS] * ratios[j] for j in near) / sum(kernel[j - i + RADIUS] for j in near))
    return out


def deviation(values: list[float]) -> float:
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def _sums(page: Lines, amount: list[int]) -> list[int]:
    """By node, what the lines below it have."""
    held = [0] * len(page.tag)
    for (node, *_), n in zip(page.lines, amount):
        held[node] += n
    for n in range(len(held) - 1, 0, -1):
        held[page.parent[n]] += held[n]
    return held


def _out(page: Lines) -> list[bool]:
    """By node, whether it is in an element that never counts.

    A form or a cue is no sign against an element that holds most of the page's text, or its article, unless there is a heading of the
    first rank or an article's text outside of it; nor if nothing else would be left.
    """
    never = [flag in ("dropped", "boilerplate", "comments") for flag in page.flag]
    main = [tag in ("article", "main") for tag in page.tag]
    for n in range(1, len(page.tag)):
        never[n] |= never[page.parent[n]]
        main[n] |= main[page.parent[n]]
    chars = _sums(page, [0 if never[node] else len(text) for node, text, _, _ in page.lines])
    bodies = _sums(page, [int(not never[node] and (main[node] or page.tag[node] == "h1")) for node, *_ in page.lines])
    bad = list(never)
    for n, flag in enumerate(page.flag):
        if flag in ("form", "cue"):
            bad[n] |= not (bodies[n] == bodies[0] and (bodies[n] or 2 * chars[n] > chars[0]))
        bad[n] |= n > 0 and bad[page.parent[n]]
    return bad if any(not bad[node] for node, *_ in page.lines) else never


def main_text(html: str | None) -> str:
    """The main text of one page."""
    page = lines_of((html or "").replace("<![", "<! ["))  # the parser knows no such sections
    bad = _out(page)
    lines = page.lines
    good = [not bad[node] for node, *_ in lines]
    if not any(good):
        return ""
    ratios = [len(text) / tags for _, text, tags, _ in lines]
    smooth = smoothed(ratios)
    least = deviation(smooth)
    content = [g and s >= least for g, s in zip(good, smooth)]
    strong = [c and r >= least for c, r in zip(content, ratios)]
    if not any(content):
        content = strong = good
    kept = _region(page, content, strong, good, ratios)
    return "\n".join(text for (_, text, _, _), keep in zip(lines, kept) if keep)


def _region(page: Lines, content: list[bool], strong: list[bool], good: list[bool], ratios: list[float]) -> list[bool]:
    """By line, whether it is main text."""
    lines, n = page.lines, len(page.lines)
    mass = _sums(page, [len(text) * c for (_, text, _, _), c in zip(lines, content)])
    firm = _sums(page, [int(s) for s in strong])
    titles = _sums(page, [int(g and page.tag[node] == "h1") for (node, *_), g in zip(lines, good)])
    ends = list(range(1, len(page.tag) + 1))  # a node and those below it are neighbours in order
    kids: list[list[int]] = [[] for _ in page.tag]
    for node in range(len(page.tag) - 1, 0, -1):
        up = page.parent[node]
        ends[up] = max(ends[up], ends[node])
        if mass[node] and page.tag[node] not in LEAVES:
            kids[up].append(node)

    def below(i: int, node: int) -> bool:
        return node <= lines[i][0] < ends[node]

    at, title, main = 0, n, False
    while kids[at]:
        best = max(kids[at], key=lambda k: (mass[k], -k))
        body = page.tag[best] in ("article", "main")
        if not (body and 2 * mass[best] >= mass[at] or mass[best] >= MOST * mass[at] and firm[best] == firm[at]):
            break
        if titles[at] and not titles[best]:
            begin = next(i for i in range(n) if below(i, best))
            title = min([title, *(i for i in range(begin) if below(i, at) and good[i] and page.tag[lines[i][0]] == "h1")])
        at, main = best, main or body
    begin = next((i for i in range(n) if below(i, at)), 0)
    region = [good[i] and (below(i, at) or title <= i < begin) for i in range(n)]
    return region if main else _trimmed(page, region, strong, ratios, title)


def _trimmed(page: Lines, region: list[bool], strong: list[bool], ratios: list[float], title: int) -> list[bool]:
    """The region without bare lines of low ratios at its edges, and without lists of links."""
    kept, within = list(region), [i for i, r in enumerate(region) if r]
    least = min((r for r, s in zip(ratios, strong) if s), default=0)
    for order in (within, within[::-1]):
        for i in order:
            node, text, _, linked = page.lines[i]
            if i == title or ratios[i] >= least or page.tag[node] in LEAVES and 2 * linked <= len(text):
                break
            kept[i] = False
    by_list: dict[int, list[int]] = {}
    for i in within:
        if page.tag[page.lines[i][0]] == "li":
            by_list.setdefault(page.parent[page.lines[i][0]], []).append(i)
    for found in by_list.values():
        if len(found) >= MENU_LINKS and all(page.lines[i][3] >= len(page.lines[i][1]) for i in found):
            for i in found:
                kept[i] = False
    return kept


def extract(pages: DataFrame, html: str = "html", names: tuple[str, str] = ("text", "n_chars")) -> DataFrame:
    """pages without their html and with two columns more, names: the main text and its number of characters (code points)."""
    small_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c.lower() not in {html.lower(), *(n.lower() for n in names)}]
    rows = pages.select(*(col(c).alias(f"c{i}") for i, c in enumerate(rest)), col(html).cast("string").alias("html"))
    fields = [*rows.schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [f.name for f in fields])
        give_back()

    return rows.mapInArrow(run, StructType(fields)).toDF(*rest, *names)


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
