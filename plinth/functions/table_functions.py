"""Listing pages as table functions of SQL.

`posting_rows(html, city, origin, agency, page)` gives a row a posting of one page, in a lateral join; its argument `fields`, a list of
names as text, chooses the columns, so its schema depends on the call:

    SELECT p.page, j.* FROM pages p, LATERAL posting_rows(p.html, p.city, p.origin, p.agency, p.page, fields => 'title, salary') j

`city_postings(TABLE(pages))` reads a table of pages, partitioned by city and ordered by page as the function itself asks
for, and gives each posting of a city's agency once, the first. A partition is a city's pages, one after another; what it holds
is the ids of the city's postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .html import listing

TEXTS = ("posting_id", "title", "city", "url", "location", "job_type", "salary", "department", "description", "agency_code", "categories")
NUMBERS = ("position", "source_page")
COLUMNS = ("position", *TEXTS, "source_page")


def _schema(names: tuple[str, ...]) -> StructType:
    return StructType([StructField(n, IntegerType() if n in NUMBERS else StringType()) for n in names])


def _postings(html, city, origin, agency, page) -> Iterator[dict]:
    for position, job in enumerate(listing(html, city or "", origin or "", agency or "", int(page or 0))["jobs"]):
        yield {"position": position} | {k: v for k, v in job.items() if k != "raw_data"} | job["raw_data"]


@dataclass
class _Chosen(AnalyzeResult):
    names: tuple[str, ...] = COLUMNS


class PostingRows:
    def __init__(self, analyzed: _Chosen = None):
        self.names = analyzed.names if analyzed else COLUMNS

    @staticmethod
    def analyze(html: AnalyzeArgument, city: AnalyzeArgument, origin: AnalyzeArgument, agency: AnalyzeArgument, page: AnalyzeArgument, fields: AnalyzeArgument = None) -> _Chosen:
        if fields is None:
            return _Chosen(_schema(COLUMNS))
        if not fields.isConstantExpression or not isinstance(fields.value, str):
            raise ValueError("fields is a constant text")
        names = tuple(n.strip() for n in fields.value.split(","))
        if unknown := [n for n in names if n not in COLUMNS]:
            raise ValueError(f"no such field: {', '.join(unknown)}")
        return _Chosen(_schema(names), names=names)

    def eval(self, html, city, origin, agency, page, fields=None):
        for row in _postings(html, city, origin, agency, page):
            yield tuple(row[n] for n in self.names)


class CityPostings:
    def __init__(self):
        self.seen: set[tuple[str, str]] = set()

    @staticmethod
    def analyze(pages: AnalyzeArgument) -> AnalyzeResult:
        if not pages.isTable or (missing := {"city", "origin", "agency", "page", "html"} - set(pages.dataType.names)):
            raise ValueError(f"a table of pages is needed, with {', '.join(sorted(missing)) if pages.isTable else 'city, origin, agency, page, html'}")
        return AnalyzeResult(_schema(COLUMNS), partitionBy=[PartitioningColumn("city")], orderBy=[OrderingColumn("page")])

    def eval(self, row):
        for job in _postings(row["html"], row["city"], row["origin"], row["agency"], row["page"]):
            key = job["agency_code"].lower(), job["posting_id"]
            if key not in self.seen:
                self.seen.add(key)
                yield tuple(job[n] for n in COLUMNS)


def register(spark: SparkSession) -> None:
    """The functions by name, for SQL of this session."""
    spark.udtf.register("posting_rows", udtf(PostingRows))
    spark.udtf.register("city_postings", udtf(CityPostings))
