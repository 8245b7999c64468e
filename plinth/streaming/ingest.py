"""Jobs as streams: stored pages and polled portals, each job once, and the end of its time to live.

`lifetimes` keeps one timestamp for each key as state, its last sighting, and a timer that ends it: a key is new when it is
seen first, or again after more than `ttl` without a sighting, and expired at its last sighting and `ttl`, once the watermark has passed
that. Sightings within a batch may come in any order and twice; those older than the watermark drop out, as in every stateful
operator, and one that is older than the last sighting changes nothing. After a restart the state is that of the
checkpoint and the last batch is read again, so nothing is lost or told twice. Keys are spread over the tasks (a city with
a third of all jobs is many keys), and a state is gone when its key expires.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from ..functions.html import parse_listings
from ..functions.identity import with_identity

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAGES = "city string, origin string, agency string, page int, html string, fetched_at timestamp"


def job_stream(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """A streaming table of jobs from JSON files of pages; repeats of a job within `late` of each other drop out."""
    pages = spark.readStream.schema(PAGES).json(path)
    jobs = parse_listings(pages).select("fetched_at", F.explode("jobs").alias("job")).select("fetched_at", "job.*")
    return with_identity(jobs).withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["job_id"])


def arrivals(jobs: DataFrame, window: str = "1 hour") -> DataFrame:
    """Jobs by city and window of arrival; a window closes when the watermark passes it."""
    return jobs.groupBy(F.window("fetched_at", window), "city").agg(F.count(F.lit(1)).alias("jobs"))


class _Lifetime(StatefulProcessor):
    """The last sighting of a key in milliseconds, and the timer of its end."""

    def __init__(self, keys: list[str], columns: list[str], at: str, ttl_ms: int):
        self.keys, self.columns, self.at, self.ttl = keys, columns, at, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = before = self.last.get()[0] if self.last.exists() else None
        for ms, row in sorted(((_ms(r[self.at]), r) for r in rows), key=lambda x: x[0]):
            if last is not None and ms > last + self.ttl:
                yield self._expired(key, last)
                last = None
            if last is None:
                yield Row(*self.columns, "event", "event_at")(*row, "new", row[self.at])
            last = ms if last is None else max(last, ms)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl)
            self.last.update((last,))
            self.handle.registerTimer(last + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            last = self.last.get()[0]
            if last + self.ttl <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield self._expired(key, last)

    def _expired(self, key, last: int) -> Row:
        told = dict(zip(self.keys, key))
        return Row(*self.columns, "event", "event_at")(*(told.get(c) for c in self.columns), "expired", datetime.datetime.fromtimestamp((last + self.ttl) / 1000))

    def close(self) -> None:
        pass


def _ms(at: datetime.datetime) -> int:
    return round(at.timestamp() * 1000)


def lifetimes(rows: DataFrame, keys: list[str], at: str, ttl: datetime.timedelta, late: str = "1 hour") -> DataFrame:
    """rows (a stream) with event and event_at, where a key is new; and a row of the key only where it is expired.

    Rows without a time or with a null key drop out. The session's state store is set to RocksDB, which such state needs.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    known = rows.where(F.col(at).isNotNull() & ~F.exists(F.array(*(F.col(k).isNull() for k in keys)), lambda x: x)).withWatermark(at, late)
    schema = StructType([*(StructField(f.name, f.dataType) for f in known.schema), StructField("event", StringType()), StructField("event_at", TimestampType())])
    processor = _Lifetime(keys, known.columns, at, round(ttl.total_seconds() * 1000))
    return known.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime")


def new_postings(polled: DataFrame, forget: datetime.timedelta = datetime.timedelta(days=30), late: str = "1 hour") -> DataFrame:
    """The postings of a stream of the portal source, each once, however many polls list it; again only after `forget` without it."""
    return lifetimes(polled, ["agency_code", "posting_id"], "polled_at", forget, late).where("event = 'new'").drop("event", "event_at")
