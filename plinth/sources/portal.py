"""Portals as a Python data source: one input partition a city, pages read in turn.

Pages come from a fetch function (http_fetch over the network), so that tests and stored pages need none. Options: cities (JSON of
[city, url] pairs), max_pages, attempts. Stored pages, a table of (city, page, html), are parsed in parallel
by `jobs_of_pages` instead.

Read as a stream the source polls each city once in `interval` seconds. Its offset tells for every city the number of
the interval that its last poll was for, counted by the clock alone, so a restarted stream goes on from its checkpoint: a batch
that had not been committed is read again under the same offsets, and however many intervals a stop took, one poll
brings what the portal lists now. Cities begin their intervals at different times (by a hash of the name), each is an input
partition, and rows tell when their interval began (polled_at). A city new to the list is polled at once, one that left it no more. With
on_error=skip a city that fails has no rows in this poll; else the batch fails and is tried again after a restart.
A portal lists a posting in every poll; `streaming.ingest.new_postings` passes each one once.
"""

from __future__ import annotations

import datetime
import json
import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode, urlsplit
from urllib.request import Request, urlopen
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import PortalError
from ..functions.html import listing, parse_details, parse_listings
from ..operators.dedup import first_by_key
from ..operators.joins import OVERLAY_FIELDS, overlay
from ..operators.models import in_flight

Fetch = Callable[[str, dict], str]
TIMEOUT_SECONDS = 30
POLL_SECONDS = 3600
DETAIL_WORKERS = 5
DEFAULT_ORIGIN = "https://www.governmentjobs.com"
FIELDS = ("title", "city", "url", "location", "job_type", "salary", "department", "description")


def http_fetch(url: str, params: dict | None = None, timeout: float = TIMEOUT_SECONDS) -> str:
    """A page over HTTP. Listing pages (with params) are asked for as a browser's script does; an error status raises."""
    headers = {"User-Agent": "plinth"} | ({"X-Requested-With": "XMLHttpRequest"} if params is not None else {})
    target = f"{url}?{urlencode(params)}" if params else url
    with urlopen(Request(target, headers=headers), timeout=timeout) as reply:
        return reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace")


def agency_of(url: str) -> str:
    found = re.search(r"/careers/([^/?#]+)", url, re.I)
    if not found:
        raise PortalError(f"no agency in {url}")
    return found[1]


def origin_of(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}" if parts.scheme and parts.netloc else DEFAULT_ORIGIN


def with_retry(call: Callable[[], object], attempts: int, sleep: Callable[[float], None] = time.sleep):
    """call's result, after at most so many attempts (None for none), 2 ** k seconds apart."""
    for k in range(attempts):
        try:
            return call()
        except Exception as error:
            if k + 1 == attempts:
                raise PortalError(f"failed after {attempts} attempts: {error}") from error
            sleep(2**k)
    return None


def read_portal(city: str, url: str, fetch: Fetch, max_pages: int = 100) -> Iterator[dict]:
    """The jobs of all listing pages, each posting once; stops when the portal has no more."""
    agency, origin = agency_of(url), origin_of(url)
    page, visited, ids, reported = 1, set(), set(), None
    while page and page <= max(1, max_pages) and page not in visited:
        visited.add(page)
        found = listing(fetch(f"{origin}/careers/home/index", {"agency": agency, "page": page}), city, origin, agency, page)
        reported = found["reported_count"] if reported is None else reported
        if page == 1 and not found["jobs"] and reported != 0:
            raise PortalError(f"no listing for {city}")
        new = [j for j in found["jobs"] if j["raw_data"]["posting_id"] not in ids]
        ids |= {j["raw_data"]["posting_id"] for j in new}
        yield from new
        if (reported is not None and len(ids) >= reported) or (page > 1 and not new):
            break
        page = found["next_page"]


class _City(InputPartition):
    def __init__(self, city: str, url: str, polled_at: datetime.datetime | None = None):
        self.city, self.url, self.polled_at = city, url, polled_at


class _Portals:
    """What reading a table and reading a stream share."""

    def __init__(self, fetch: Fetch, options: dict):
        self.fetch, self.options = fetch, options

    def cities(self) -> dict[str, str]:
        return dict(json.loads(self.options.get("cities", "[]")))

    def jobs(self, partition: _City) -> Iterator[tuple]:
        def row(job: dict) -> tuple:
            raw = job["raw_data"]
            return (*(job[f] for f in FIELDS), raw["platform"], raw["posting_id"], raw["agency_code"], raw["categories"], raw["source_page"], partition.polled_at)

        def found():
            return [row(job) for job in read_portal(partition.city, partition.url, self.fetch, int(self.options.get("max_pages", 100)))]

        yield from with_retry(found, int(self.options.get("attempts", 2))) or ()


class _Reader(_Portals, DataSourceReader):
    def partitions(self):
        return [_City(c, u) for c, u in json.loads(self.options.get("cities", "[]"))]

    def read(self, partition: _City):
        yield from self.jobs(partition)


class _StreamReader(_Portals, DataSourceStreamReader):
    """Offsets are {city: number of the interval}."""

    def __init__(self, fetch: Fetch, options: dict, clock: Callable[[], float]):
        super().__init__(fetch, options)
        self.clock, self.interval = clock, float(options.get("interval", POLL_SECONDS))

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.cities(), 0)

    def latestOffset(self) -> dict:
        now = self.clock() / self.interval
        return {city: int(now - self._turn(city)) for city in self.cities()}

    def _turn(self, city: str) -> float:
        return crc32(city.encode()) / 2**32

    def _began(self, city: str, poll: int) -> datetime.datetime:
        return datetime.datetime.fromtimestamp((poll + self._turn(city)) * self.interval, datetime.timezone.utc)

    def partitions(self, start: dict, end: dict):
        urls = self.cities()
        return [_City(city, urls[city], self._began(city, poll)) for city, poll in end.items() if city in urls and poll > start.get(city, 0)]

    def read(self, partition: _City):
        try:
            yield from list(self.jobs(partition))
        except PortalError:
            if self.options.get("on_error") != "skip":
                raise

    def commit(self, end: dict) -> None:
        """Nothing is held for a replay: a portal can be asked again."""


def portal_source(fetch: Fetch, clock: Callable[[], float] = time.time) -> type[DataSource]:
    """A data source named `portal` that reads with fetch, as a table or a stream; register it with spark.dataSource.register."""

    class Portal(DataSource):
        @classmethod
        def name(cls):
            return "portal"

        def schema(self):
            return ", ".join(f"{f} string" for f in FIELDS) + ", platform string, posting_id string, agency_code string, categories string, source_page int, polled_at timestamp"

        def reader(self, schema):
            return _Reader(fetch, dict(self.options))

        def streamReader(self, schema):
            return _StreamReader(fetch, dict(self.options), clock)

    return Portal


def jobs_of_pages(pages: DataFrame) -> DataFrame:
    """The jobs of stored listing pages (city, origin, agency, page, html), the first of each posting."""
    parsed = parse_listings(pages).select("page", F.posexplode("jobs").alias("pos", "job"))
    rows = parsed.select("job.*", F.col("page").alias("_page"), F.col("pos").alias("_pos"))
    keyed = rows.withColumns({"_agency": F.lower("raw_data.agency_code"), "_posting": F.col("raw_data.posting_id")})
    return first_by_key(keyed, ["_agency", "_posting"], ["_page", "_pos"]).drop("_agency", "_posting", "_page", "_pos")


def fetched_details(jobs: DataFrame, fetch: Fetch, workers: int = DETAIL_WORKERS) -> DataFrame:
    """url and html of the jobs' detail pages, each url once; what can't be fetched has no row.

    A city's pages are asked for by one task, at most `workers` at once, so that is the bound for a portal too.
    """
    urls = jobs.where(F.col("url").isNotNull()).select("city", "url").dropDuplicates(["url"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0).to_pylist()
            found = [(u, p) for u, p in zip(asked, in_flight(lambda u: fetch(u, None), asked, workers)) if not isinstance(p, Exception)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], ["url", "html"])

    return urls.repartition("city").select("url").mapInArrow(run, "url string, html string")


def enriched(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """jobs with what their stored detail pages (url, html) tell; jobs without a page stay as they are."""
    found = pages.select("url", parse_details(F.col("html")).alias("d")).select("url", "d.*")
    complete = jobs
    for name in OVERLAY_FIELDS:
        if name not in complete.columns:
            complete = complete.withColumn(name, F.lit("").cast("string"))
    numbers = found.select("url", F.nullif("job_number", F.lit("")).alias("_number"))
    out = overlay(complete, found, "url").join(numbers, "url", "left")
    return out.withColumn("raw_data", F.col("raw_data").withField("job_number", F.coalesce("_number", "raw_data.job_number"))).drop("_number")
