"""As-of join, keyed upsert, sketches, observed counts, table functions, detail pages, fingerprints: against plain versions."""

import datetime
import hashlib
import random
import time
from html import escape

import pytest
from pyspark.sql import functions as F

from plinth.functions.table_functions import register
from plinth.functions.text import advice_card
from plinth.operators.asof import asof
from plinth.operators.dedup import fingerprint, fingerprints
from plinth.operators.observed import Progress
from plinth.plans.profile import upserted
from plinth.plans.search_jobs import Request, search_jobs
from plinth.schemas import ADVICE, PROFILE
from plinth.sources.portal import fetched_details
from plinth.sources.sketches import ERROR, replaced, sketched, total

NOON = datetime.datetime(2024, 5, 1, 12)


def minutes(n):
    return None if n is None else NOON + datetime.timedelta(minutes=n)


@pytest.mark.parametrize("hot_least", [10_000, 3])
def test_asof(spark, hot_least):
    """Ties, nulls, keys without versions, and a key with most rows that is cut into parts."""
    rnd = random.Random(hot_least)
    key = lambda: rnd.choice(["hot"] * 6 + ["a", "b", "c", None])
    rows = [(i, key(), rnd.choice([rnd.randint(0, 300)] * 9 + [None])) for i in range(150)] + [(900, "hot", 150)] * 2
    versions = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.choice([rnd.randint(0, 300), 150, None]), i) for i in range(60)]
    left = spark.createDataFrame([(i, k, minutes(t)) for i, k, t in rows], "id long, city string, at timestamp_ntz").repartition(3)
    right = spark.createDataFrame([(k, minutes(t), i, f"v{i}") for k, t, i in versions], "city string, cached_at timestamp_ntz, no long, value string").repartition(3)
    got = sorted((tuple(r) for r in asof(left, right, "city", "at", "cached_at", ["value", "no"], "no", hot_least).collect()), key=str)

    def last(k, t):
        fits = [(v, i) for c, v, i in versions if None not in (k, t, v) and c == k and v <= t]
        return (f"v{max(fits)[1]}", max(fits)[1]) if fits else (None, None)

    assert got == sorted(((i, k, minutes(t), *last(k, t)) for i, k, t in rows), key=str)
    assert asof(left.limit(0), right, "city", "at", "cached_at", ["value"], "no").count() == 0
    assert {r["value"] for r in asof(left, right.limit(0), "city", "at", "cached_at", ["value"], "no").collect()} == {None}


def test_asof_makes_no_pairs(spark):
    rows = spark.createDataFrame([("a", minutes(1))], "city string, at timestamp_ntz")
    versions = spark.createDataFrame([("a", minutes(0), 1)], "city string, cached_at timestamp_ntz, no long")
    plan = asof(rows, versions, "city", "at", "cached_at", ["no"], "no")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def profile(**told):
    return tuple(told.get(n) for n in PROFILE.names)


def test_upsert(spark):
    parsed = lambda name: (None,) * 7 + (name,)
    old = [("s1", *profile(name="Ann", degree="BA", resume_parsed=parsed("Ann"), created_at=minutes(-60))), ("s2", *profile(name="Bo")), ("s3", *profile(name="Cy", created_at=minutes(-5)))]
    profiles = spark.createDataFrame(old, "session_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PROFILE))
    fields = [n for n in PROFILE.names if n != "created_at"]
    updates = [
        ("s1", 3, 1, {"name": "late"}), ("s1", 2, 9, {"name": "early", "degree": "MA"}), ("s1", 4, 1, {"degree": None}), ("s1", 5, 1, {"sets": True}),
        ("s2", 1, 1, {"name": "first"}), ("s2", 1, 2, {"name": "tie", "interests": ["x"]}), ("s4", 7, 1, {"name": "new"}), ("s4", 6, 1, {"resume_parsed": parsed("P"), "sets": True}),
        (None, 1, 1, {"name": "nobody"}), ("s2", None, 3, {"name": "no time"}), ("s3", 1, 1, {"resume_parsed": parsed("not set")}),
    ]
    kinds = ", ".join(f"{n} {PROFILE[n].dataType.simpleString()}" for n in fields)
    new = spark.createDataFrame([(s, minutes(t), q, *(u.get(n) for n in fields), u.get("sets")) for s, t, q, u in updates], f"session_id string, at timestamp_ntz, seq long, {kinds}, sets_resume_parsed boolean").repartition(3)
    got = {r["session_id"]: r for r in upserted(profiles, new).collect()}
    assert sorted(got) == ["s1", "s2", "s3", "s4"]
    assert (got["s1"]["name"], got["s1"]["degree"], got["s1"]["resume_parsed"], got["s1"]["created_at"]) == ("late", "MA", None, minutes(-60))
    assert (got["s2"]["name"], got["s2"]["interests"], got["s2"]["created_at"]) == ("tie", ["x"], minutes(1))
    assert (got["s3"]["name"], got["s3"]["resume_parsed"], got["s3"]["created_at"]) == ("Cy", None, minutes(-5))
    assert (got["s4"]["name"], got["s4"]["resume_parsed"]["name"], got["s4"]["created_at"]) == ("new", "P", minutes(6))
    assert upserted(profiles.limit(0), new.limit(0)).count() == 0 and upserted(profiles, new.limit(0)).count() == 3


@pytest.mark.parametrize("distinct", [0, 7, 5000, 40_000])
def test_sketches(spark, distinct):
    """Cities that share jobs: the union's estimate against the exact count, within three standard errors."""
    rows = spark.range(distinct * 2).select(F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("city"), (F.col("id") % max(distinct, 1)).cast("string").alias("job_id"))
    rows = rows.unionByName(spark.createDataFrame([("c0", None)], rows.schema))
    manifest = sketched(rows, "city", "job_id")
    again = replaced(manifest, sketched(rows.where("city = 'c1'"), "city", "job_id"), "city")
    for made in (manifest, again):
        r = total(made).first()
        assert r["job_count"] == distinct * 2 + 1 and abs(r["estimate"] - distinct) <= 3 * ERROR * distinct + 0.5
        assert r["lower"] <= distinct <= r["upper"]
    assert tuple(total(manifest.limit(0)).first()) == (0, 0, 0, 0)


def test_progress_of_a_search(spark):
    words = ["Clerk", "Pilot", "Clerk"]
    jobs = spark.createDataFrame([(f"{words[i % 3]} {i // 2}", "Tempe", f"https://e.gov/jobs/{i // 2}", i) for i in range(40)], "title string, city string, url string, pos long")
    progress = Progress()
    found = search_jobs(jobs.where("pos < 30"), jobs.where("pos >= 25"), Request("clerk", title="clerk", limit=5, dimensions=16), progress=progress)
    assert found.count() == 5
    kept = {}
    for i in range(40):
        kept.setdefault(i // 2, words[i % 3])
    assert progress.counts() == {"cached": 30, "scraped": 15, "unfiltered": 20, "retained": sum(w == "Clerk" for w in kept.values())}
    assert progress.message() == f"Search criteria retained {progress.counts()['retained']} of 20 jobs."
    with pytest.raises(ValueError):
        progress.at(jobs, "cached")
    more = Progress()
    more.at(jobs, "all", most=F.max("pos")).write.format("noop").mode("overwrite").save()
    assert more.of("all") == {"rows": 40, "most": 39}


ITEM = '<li class="list-item" data-job-id="{0}"><a class="item-details-link" href="/careers/x/jobs/{0}/y">Post {0}</a></li>'


def test_table_functions(spark):
    register(spark)
    pages = [("Tempe", 2, [3, 4]), ("Tempe", 1, [1, 2, 3]), ("Mesa", 1, [1]), ("Mesa", 2, []), (None, 1, [8])]
    rows = [(c, n, "https://e.gov", "Agency" if c == "Tempe" else "agency2", "".join(ITEM.format(i) for i in ids)) for c, n, ids in pages] + [("Mesa", 3, None, None, None)]
    spark.createDataFrame(rows, "city string, page int, origin string, agency string, html string").repartition(3).createOrReplaceTempView("some_pages")
    got = spark.sql("select p.city, p.page, j.* from some_pages p, lateral posting_rows(p.html, p.city, p.origin, p.agency, p.page, fields => 'posting_id, position') j")
    assert got.columns == ["city", "page", "posting_id", "position"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((c, n, str(i), at) for c, n, ids in pages for at, i in enumerate(ids)), key=str)
    once = spark.sql("select city, source_page, posting_id, title from city_postings(table(some_pages))").collect()
    assert sorted((r["city"], r["source_page"], r["posting_id"]) for r in once) == [("", 1, "8"), ("Mesa", 1, "1"), ("Tempe", 1, "1"), ("Tempe", 1, "2"), ("Tempe", 1, "3"), ("Tempe", 2, "4")]
    for bad in ("select * from some_pages p, lateral posting_rows(p.html, p.city, p.origin, p.agency, p.page, fields => 'nothing') j", "select * from city_postings(table(select city from some_pages))"):
        with pytest.raises(Exception, match="no such field|needed"):
            spark.sql(bad).collect()


def test_detail_pages_over_a_slow_fetch(spark):
    def fetch(url, params):
        time.sleep(0.02)
        if "bad" in url:
            raise OSError("gone")
        return f"<p>{url}</p>"

    jobs = spark.createDataFrame([("Tempe", f"u{i % 20}") for i in range(40)] + [("Mesa", "bad"), ("Mesa", None), ("Mesa", "m")], "city string, url string")
    got = {r["url"]: r["html"] for r in fetched_details(jobs, fetch, 5).collect()}
    assert got == {u: f"<p>{u}</p>" for u in [*(f"u{i}" for i in range(20)), "m"]}
    assert fetched_details(jobs.limit(0), fetch).count() == 0


def test_fingerprints(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, *map(str, range(50))])) for _ in range(300)] + [("only null", None), ("é", "é|ü")]
    df = spark.createDataFrame(rows, "city string, id string").repartition(4)
    got = {r["city"]: r["fingerprint"] for r in fingerprints(df, "city", "id").collect()}
    keys = {k for k, _ in rows}
    assert got == {k: hashlib.md5("|".join(sorted({i for c, i in rows if c == k and i is not None})).encode()).hexdigest() for k in keys}
    assert got == {r["city"]: r["f"] for r in df.groupBy("city").agg(fingerprint(F.col("id")).alias("f")).collect()}
    assert fingerprints(df.limit(0), "city", "id").count() == 0


def test_advice_card(spark):
    """The struct's fields in order: skill gaps, keywords, improvements, strengths, error."""
    rows = [(["gap"], ["<i>"], ["do 'it'", None], [], None), ([], None, [], ["a & b"], None)]
    full, bare = (r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"n int, a {ADVICE.simpleString()}").orderBy("n").select(advice_card(F.col("a"))).collect())
    assert '<section class="skill-gaps"><h4>Skill gaps to address</h4><ul><li>gap</li></ul></section>' in full
    assert f"<li>{escape('<i>')}</li>" in full and f"<ul><li>do {escape(chr(39))}it{escape(chr(39))}</li><li></li></ul>" in full and "No specific strengths identified" in full
    assert "<li>a &amp; b</li>" in bare and "No keywords suggested" in bare and "No major skill gaps" in bare and "No specific improvements suggested" in bare
