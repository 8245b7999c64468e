"""Portal pages to records. Parsing is Python (html.parser), in Arrow batches; the rest is columns."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..schemas import RAW_DATA

#: Labels of detail pages and the fields that they fill.
TERM_FIELDS = {
    "salary": "salary",
    "location": "location",
    "job type": "job_type",
    "job number": "job_number",
    "department": "department",
    "division": "department",
    "opening date": "posted_date",
    "closing date": "closing_date",
}
DETAIL_FIELDS = ("description", "requirements", "location", "department", "salary", "posted_date", "closing_date", "job_number", "job_type")
REQUIREMENT_HEADING = re.compile("qualification|requirement|education|experience", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Fixed values of HTML: which start tags end an open paragraph or an open sibling, and what holds a paragraph or list together.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())
HOLDS_PARAGRAPH = frozenset("button caption object table td template th".split())
ENDS_SIBLING = {
    "li": (("li",), frozenset(("ul", "ol", "menu"))),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "option": (("option",), frozenset(("select", "datalist"))),
    "tr": (("tr",), frozenset(("table",))),
    "td": (("td", "th"), frozenset(("tr", "table"))),
    "th": (("td", "th"), frozenset(("tr", "table"))),
}
PAGES_AT_ONCE = 50
_SPACE = re.compile(r"\s+")
#: An ampersand that begins no reference with a semicolon; comments, scripts and styles, which have no references, are passed over.
_OPEN_REFERENCE = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|&(?!#?[0-9A-Za-z]+;)", re.S | re.I)


def clean(text: str | None) -> str:
    return _SPACE.sub(" ", text or "").strip()


class Node:
    """An element: its tag, attributes and children (elements and strings)."""

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.classes = frozenset(attrs.get("class", "").split())

    def _nodes(self) -> Iterator[Node | str]:
        """Elements and strings below, in order; pages may nest as deeply as they like."""
        stack = self.children[::-1]
        while stack:
            at = stack.pop()
            yield at
            if isinstance(at, Node):
                stack += at.children[::-1]

    def walk(self) -> Iterator[Node]:
        return (n for n in self._nodes() if isinstance(n, Node))

    def strings(self) -> Iterator[str]:
        return (n.strip() for n in self._nodes() if isinstance(n, str) and n.strip())

    def text(self) -> str:
        return clean(" ".join(self.strings()))

    def all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.walk() if test(n)]

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if test(n)), None)

    def elements(self, tag: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.tag == tag]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open, self.times = [self.root], Counter()

    def _close(self, tags: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of some tags, with all in it, unless an element of within is further in."""
        if not any(self.times[t] for t in tags):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in tags:
                self.times.subtract(n.tag for n in self.open[depth:])
                del self.open[depth:]
                return
            if self.open[depth].tag in within:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close(("p",), HOLDS_PARAGRAPH)
        if tag in ENDS_SIBLING:
            self._close(*ENDS_SIBLING[tag])
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.times[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        self._close((tag,))

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(page: str | None) -> Node:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def fragment_text(value: str | None) -> str:
    """The text of an escaped piece of HTML."""
    return parse(html.unescape(value or "")).text()


def _has(tag: str, cls: str) -> Callable[[Node], bool]:
    return lambda n: n.tag == tag and cls in n.classes


def _prefixed(items: list[str], *prefixes: str) -> str:
    for item in items:
        for prefix in prefixes:
            if item.lower().startswith(prefix):
                return item[len(prefix) :].strip()
    return ""


def listing(page: str | None, city: str, origin: str, agency: str, number: int) -> dict:
    """The jobs of a listing page in order, its next page's number and the count it reports."""
    root, jobs, seen = parse(page), [], set()
    for item in root.all(_has("li", "list-item")):
        link = item.first(lambda n: n.tag == "a" and "item-details-link" in n.classes and "href" in n.attrs)
        if link is None:
            continue
        title, url = link.text(), urljoin(origin, link.attrs["href"])
        told = re.search(r"(?:/jobs/|^)(\d+)(?:/|$)", item.attrs.get("data-job-id") or urlsplit(url).path)
        if not title or told is None or (key := (agency.lower(), told[1])) in seen:
            continue
        seen.add(key)
        metas = [li for ul in item.all(_has("ul", "list-meta")) for li in ul.elements("li")]
        texts = [m.text() for m in metas]
        employment = [t for s in (metas[1].strings() if len(metas) > 1 else ()) if (t := clean(s)) not in ("", "-")]
        entry = item.first(lambda n: "list-entry" in n.classes)
        jobs.append({
            "title": title, "city": city, "url": url, "location": (texts[0] if texts else "") or city,
            "job_type": employment[0] if employment else "", "salary": " - ".join(employment[1:]),
            "department": clean(link.attrs.get("data-department-name")) or _prefixed(texts, "department:", "division:"),
            "description": entry.text() if entry else "",
            "raw_data": {"platform": "NeoGov", "posting_id": told[1], "source_job_id": None, "agency_code": agency, "job_number": None, "categories": _prefixed(texts, "category:"), "source_page": number},
        })
    return {"jobs": jobs, "next_page": _next_page(root), "reported_count": _reported(root)}


def _next_page(root: Node) -> int | None:
    for ul in root.all(_has("ul", "pagination")):
        for a in ul.all(lambda n: n.tag == "a" and n.attrs.get("aria-disabled") == "false"):
            if a.attrs.get("rel") == "next" or a.attrs.get("aria-label") == "Go to Next Page":
                told = parse_qs(urlsplit(a.attrs.get("href", "")).query).get("page", [""])[0]
                return int(told) if told.strip().isdecimal() else None
    return None


def _reported(root: Node) -> int | None:
    node = root.first(lambda n: n.attrs.get("id") == "job-postings-number")
    found = re.search(r"\d[\d,]*", node.text()) if node else None
    return int(found[0].replace(",", "")) if found else None


def job_posting(root: Node) -> dict:
    """The first JobPosting of the page's JSON-LD scripts."""
    for script in root.all(lambda n: n.tag == "script" and n.attrs.get("type") == "application/ld+json"):
        try:
            told = json.loads("".join(c for c in script.children if isinstance(c, str)))
        except ValueError:
            continue
        for one in told if isinstance(told, list) else [told]:
            if isinstance(one, dict) and one.get("@type") == "JobPosting":
                return one
    return {}


def _inner(value, *path):
    for name in path:
        if isinstance(value, list):
            value = value[0] if value else None
        value = value.get(name) if isinstance(value, dict) else None
    return value


def structured_location(posting: dict) -> str:
    parts = (clean(str(_inner(posting, "jobLocation", "address", f) or "")) for f in ("streetAddress", "addressLocality", "addressRegion", "postalCode"))
    return ", ".join(p for p in parts if p)


def structured_salary(posting: dict) -> str:
    low, high = (_inner(posting, "baseSalary", "value", f) for f in ("minValue", "maxValue"))
    told = [f"${x:,.2f}" for x in (low, high) if isinstance(x, (int, float))]
    return f"{' - '.join(told)} {clean(_inner(posting, 'baseSalary', 'value', 'unitText')).title()}".strip() if told else ""


def details(page: str | None) -> dict[str, str]:
    """The fields of a detail page: labelled blocks, sections, then JSON-LD for what is still empty."""
    root, out, explicit = parse(page), dict.fromkeys(DETAIL_FIELDS, ""), False
    for block in root.all(lambda n: "term-block" in n.classes):
        label, value = block.first(lambda n: "term-description" in n.classes), block.first(lambda n: "span8" in n.classes)
        name = label.text().lower() if label else ""
        field = TERM_FIELDS.get(name)
        if field and value and (text := value.text()):
            if name != "division" or not (explicit or out["department"]):
                out[field] = text
            explicit |= name == "department"
    sections: dict[str, list[str]] = {"description": [], "requirements": []}
    info = root.first(lambda n: n.attrs.get("id") == "details-info")
    for dl in info.all(lambda n: n.tag == "dl") if info else ():
        content = ""  # of the nearest dd after, so from the end
        found = []
        for node in reversed([c for c in dl.children if isinstance(c, Node)]):
            if node.tag == "dd":
                content = node.text()
            elif node.tag == "dt" and content and (heading := node.text()):
                found.append((heading, content))
        for heading, content in reversed(found):
            sections["requirements" if REQUIREMENT_HEADING.search(heading) else "description"].append(f"{heading}\n{content}")
    out |= {k: "\n\n".join(v) for k, v in sections.items() if v}
    posting = job_posting(root)
    fallback = {
        "description": fragment_text(posting.get("description")), "posted_date": clean(posting.get("datePosted")), "closing_date": clean(posting.get("validThrough")),
        "location": structured_location(posting), "salary": structured_salary(posting), "job_type": clean(str(posting.get("employmentType") or "")),
    }
    return {k: v or fallback.get(k, "") for k, v in out.items()}


def article_text(page: str | None, terminated: bool = False) -> str:
    """The text of a page's first article element, or of the page.

    As in HTML, old references need no semicolon (`&amp`); with terminated, what has none is text, so a reference that was cut stays as it is.
    """
    if terminated:
        page = _OPEN_REFERENCE.sub(lambda m: "&amp;" if m[0] == "&" else m[0], page or "")
    root = parse(page)
    return (root.first(lambda n: n.tag == "article") or root).text()


def _job_type() -> StructType:
    names = ("title", "city", "url", "location", "job_type", "salary", "department", "description")
    return StructType([*(StructField(n, StringType()) for n in names), StructField("raw_data", RAW_DATA)])


def _listings(columns: tuple[pa.Array, ...], kind: pa.DataType) -> pa.Array:
    """A batch's listings. Parsed jobs are large as Python objects, so the pages become Arrow a few at a time."""
    parts = [pa.array([], kind)]
    for at in range(0, len(columns[0]), PAGES_AT_ONCE):
        pages = zip(*(c.slice(at, PAGES_AT_ONCE).to_pylist() for c in columns))
        parts.append(pa.array([listing(h, c or "", o or "", a or "", int(p)) for c, o, a, p, h in pages], kind))
    return pa.concat_arrays(parts)


def parse_listings(pages: DataFrame) -> DataFrame:
    """pages (city, origin, agency, page, html) with jobs, next_page and reported_count."""
    kind = StructType([StructField("jobs", ArrayType(_job_type())), StructField("next_page", IntegerType()), StructField("reported_count", IntegerType())])
    told = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(city: pa.Array, origin: pa.Array, agency: pa.Array, page: pa.Array, text: pa.Array) -> pa.Array:
        return _listings((city, origin, agency, page, text), told)

    return pages.withColumn("_l", run("city", "origin", "agency", "page", "html")).select(*pages.columns, "_l.*")


def parse_details(page: Column) -> Column:
    """DETAIL_FIELDS of a detail page as a struct."""
    kind = StructType([StructField(n, StringType()) for n in DETAIL_FIELDS])

    @F.pandas_udf(kind)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([details(p) for p in pages], columns=list(DETAIL_FIELDS))

    return run(page)


def parse_article(page: Column, terminated: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([article_text(p, terminated) for p in pages], dtype=object)

    return run(page)
