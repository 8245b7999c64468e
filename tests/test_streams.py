"""The polled portal, time to live as state, and restarts."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plinth.sources.portal import portal_source
from plinth.streaming.ingest import lifetimes, new_postings

ORIGIN = "https://www.governmentjobs.com"
EPOCH = datetime.datetime(2024, 1, 1)


def page(ids):
    items = "".join(f'<li class="list-item" data-job-id="{i}"><h3><a class="item-details-link" href="/careers/x/jobs/{i}/clerk">Clerk {i}</a></h3></li>' for i in ids)
    return f'<span id="job-postings-number">{len(ids)}</span><ul>{items}</ul>'


def portal(world):
    """fetch and clock read the world's file anew at each call, on executors too: {now, agencies: {agency: ids or null}}."""

    def told():
        with open(world) as f:
            return json.load(f)

    def fetch(url, params):
        ids = told()["agencies"][params["agency"]]
        if ids is None:
            raise OSError("no answer")
        return page(ids)

    return portal_source(fetch, lambda: told()["now"])


def cities(*names):
    return json.dumps([[n.title(), f"{ORIGIN}/careers/{n}"] for n in names])


class Poller:
    """A stream of the portal into a Parquet folder; each run is a new query on the same checkpoint."""

    def __init__(self, spark, folder, stage=lambda df: df):
        self.spark, self.folder, self.stage, self.world = spark, folder, stage, str(folder / "world.json")
        spark.dataSource.register(portal(self.world))

    def run(self, now, names, agencies, **options):
        (self.folder / "world.json").write_text(json.dumps({"now": now, "agencies": agencies}))
        df = self.spark.readStream.format("portal").option("cities", cities(*names)).option("interval", "100").option("attempts", "1").options(**options).load()
        query = self.stage(df).writeStream.format("parquet").option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start(str(self.folder / "out"))
        query.awaitTermination(120)
        assert query.exception() is None

    def rows(self):
        return sorted((r["city"], r["posting_id"]) for r in self.spark.read.parquet(str(self.folder / "out")).collect())


def test_polls_go_on_after_a_restart(spark, tmp_path):
    p = Poller(spark, tmp_path)
    p.run(1000, ["tempe", "mesa"], {"tempe": [1, 2], "mesa": [7]})
    first = [("Mesa", "7"), ("Tempe", "1"), ("Tempe", "2")]
    assert p.rows() == first
    p.run(1001, ["tempe", "mesa"], {"tempe": [1, 2, 3], "mesa": [7]})  # the same intervals (or the next for one): at most one poll a city
    p.run(1099, ["tempe", "mesa"], {"tempe": [1, 2, 3], "mesa": [7]})
    second = p.rows()
    assert set(second) == {*first, ("Tempe", "3")} and len(second) == 7
    p.run(1900, ["tempe", "mesa"], {"tempe": [3], "mesa": [7, 8]})  # many intervals later: one poll
    assert sorted(p.rows()) == sorted([*second, ("Tempe", "3"), ("Mesa", "7"), ("Mesa", "8")])


def test_new_and_left_cities(spark, tmp_path):
    p = Poller(spark, tmp_path)
    p.run(1000, ["tempe"], {"tempe": [1]})
    p.run(1001, ["mesa"], {"mesa": [7]})
    assert p.rows() == [("Mesa", "7"), ("Tempe", "1")]


def test_failing_city(spark, tmp_path):
    p = Poller(spark, tmp_path)
    p.run(1000, ["tempe", "mesa"], {"tempe": None, "mesa": [7]}, on_error="skip")
    assert p.rows() == [("Mesa", "7")]
    with pytest.raises(Exception, match="no answer"):
        p.run(1200, ["tempe", "mesa"], {"tempe": None, "mesa": [7, 8]})
    p.run(1200, ["tempe", "mesa"], {"tempe": [1], "mesa": [7, 8]})  # the failed batch is read again, whole
    assert p.rows() == [("Mesa", "7"), ("Mesa", "7"), ("Mesa", "8"), ("Tempe", "1")]


def test_each_posting_once_across_restarts(spark, tmp_path):
    p = Poller(spark, tmp_path, new_postings)
    for now, tempe in ((1000, [1, 2]), (1200, [3]), (1300, [1, 3, 4])):
        p.run(now, ["tempe", "mesa"], {"tempe": tempe, "mesa": [1]})
    with pytest.raises(Exception, match="no answer"):
        p.run(1400, ["tempe", "mesa"], {"tempe": [1, 3, 4, 5], "mesa": None})
    p.run(1400, ["tempe", "mesa"], {"tempe": [1, 3, 4, 5], "mesa": [1, 2]})
    assert p.rows() == [("Mesa", "1"), ("Mesa", "2"), ("Tempe", "1"), ("Tempe", "2"), ("Tempe", "3"), ("Tempe", "4"), ("Tempe", "5")]


def replay(batches, ttl, late):
    """(key, event, minute) by plain Python: what drops out as late, what is new, what expires once the watermark has passed."""
    seen, out, watermark = {}, [], float("-inf")
    for batch in batches:
        for key in sorted({k for k, _ in batch}):
            for at in sorted(t for k, t in batch if k == key and t > watermark):
                if key in seen and at > seen[key] + ttl:
                    out.append((key, "expired", seen.pop(key) + ttl))
                if key not in seen:
                    out.append((key, "new", at))
                seen[key] = max(at, seen.get(key, at))
        watermark = max([watermark, *(t - late for _, t in batch)])
        for key in [k for k, at in seen.items() if at + ttl <= watermark]:
            out.append((key, "expired", seen.pop(key) + ttl))
    return sorted(out)


def batches_of(seed):
    rnd, now, out = random.Random(seed), 0, []
    for _ in range(4):
        now += rnd.randint(20, 90)
        out.append([(f"job{rnd.randint(0, 9)}", now - rnd.choice([0, 3, 10, 45, 200])) for _ in range(rnd.randint(4, 14))])
    return [*out, [("last", now + 5)], [("last", now + 900)], [("last", now + 901)]]


def test_time_to_live_against_a_replay(spark, tmp_path):
    """One batch a file, and a restart half way: the state is that of the checkpoint."""
    batches, ttl, late = batches_of(1), 60, 30
    source = tmp_path / "in"
    source.mkdir()
    for half in (range(0, 4), range(4, len(batches))):
        for b in half:
            batch = batches[b]
            (source / f"{b}.json").write_text("\n".join(json.dumps({"city": "A", "job_id": k, "at": str(EPOCH + datetime.timedelta(minutes=t))}) for k, t in [*batch, *batch[:2]]))
            os.utime(source / f"{b}.json", (1_700_000_000 + b, 1_700_000_000 + b))
        df = spark.readStream.schema("city string, job_id string, at timestamp").option("maxFilesPerTrigger", 1).json(str(source))
        out = lifetimes(df, ["city", "job_id"], "at", datetime.timedelta(minutes=ttl), f"{late} minutes")
        query = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("job_id", "event", F.timestamp_diff("MINUTE", F.lit(EPOCH), F.col("event_at"))).collect()
    assert sorted(tuple(r) for r in got if r[0] != "last") == [r for r in replay(batches, ttl, late) if r[0] != "last"]
    assert {r[1] for r in got} == {"new", "expired"}


def test_null_keys_and_times_drop_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"city": None, "job_id": "1", "at": str(EPOCH)}, {"city": "A", "job_id": "1", "at": None}, {"city": "A", "job_id": "2", "at": str(EPOCH)}]
    (tmp_path / "in" / "0.json").write_text("\n".join(map(json.dumps, rows)))
    df = spark.readStream.schema("city string, job_id string, at timestamp").json(str(tmp_path / "in"))
    query = lifetimes(df, ["city", "job_id"], "at", datetime.timedelta(hours=6)).writeStream.format("memory").queryName("lives").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["job_id"], r["event"]) for r in spark.table("lives").collect()] == [("2", "new")]
