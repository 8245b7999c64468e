import random
from urllib.parse import parse_qsl, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from plinth.functions.identity import with_identity
from plinth.functions.urls import TRACKING_KEYS, canonical_url, detected_platform, host, platform_name
from plinth.operators.dedup import deduplicate_jobs, fingerprint

JOB = "title string, city string, url string, match_score string, raw_data struct<platform:string,posting_id:string>, pos long"


def jobs(spark, *rows):
    return spark.createDataFrame([(t, c, u, s, (p, i), n) for n, (t, c, u, s, p, i) in enumerate(rows)], JOB)


def ids(df):
    return [r["job_id"] for r in with_identity(df).orderBy("pos").collect()]


def test_tracking_and_case_do_not_change_an_identity(spark):
    a, b = ids(jobs(
        spark, ("Analyst", "Tempe", "https://www.governmentjobs.com/careers/tempe/jobs/123/analyst?utm_source=email#details", "80", "NeoGov", None),
        ("Analyst", "Tempe", "HTTPS://WWW.GOVERNMENTJOBS.COM/careers/tempe/jobs/123/analyst/", "80", "NeoGov", None),
    ))
    assert a == b == "job_8c2ed76db7348a0038a77d56"


def test_golden_ids(spark):
    url = "https://example.gov/jobs/"
    got = ids(jobs(
        spark, ("A", "Tempe", url + "100", "1", "NeoGov", None), ("A", "Tempe", url + "200", "1", "NeoGov", None), ("A", "Mesa", url + "100", "1", "NeoGov", None),
        ("A", "Tempe", url + "100", "1", "PeopleSoft", None), ("Seasonal Intern", "Tempe", "", "1", "NeoGov", None), ("X", "Phoenix", None, None, "PeopleSoft", "12345"),
    ))
    assert got == ["job_564a767163d9f493fb4c4028", "job_946273effb22f2b170510e16", "job_133db1e613bc7f1f035af95d", "job_2e39d0ff0dda5297a40f085b", "job_2dc5a3392bd4f0aaff5f90ed", "job_c0b119a686b4e71b53c2075e"]


def test_identity_is_idempotent(spark):
    one = with_identity(jobs(spark, ("Seasonal Intern", "Tempe", "", "1", "NeoGov", None)))
    assert with_identity(one).first()["job_id"] == one.first()["job_id"]


def test_best_copy_stays_and_ties_keep_the_first(spark):
    url = "https://ferries.example.gov/jobs/7"
    best = deduplicate_jobs(jobs(spark, ("Pilot", "Yuma", url, "12", "NeoGov", None), ("Mate", "Yuma", url + "?utm_x=1", "63", "NeoGov", None), ("Cook", "Yuma", url, "63", "NeoGov", None), ("Clerk", "Yuma", url, "bad", "NeoGov", None)))
    assert [(r["title"], r["pos"]) for r in best.collect()] == [("Mate", 0)]


def test_fingerprint(spark):
    df = spark.createDataFrame([("job_946273effb22f2b170510e16",), ("job_564a767163d9f493fb4c4028",), ("job_564a767163d9f493fb4c4028",)], "id string")
    assert df.agg(fingerprint(F.col("id"))).first()[0] == "5fa7c0d457a137c58ebabbe3cb2a1802"


def plain_canonical(url):
    """The rule once more, with the standard library."""
    url = (url or "").strip()
    if not url:
        return ""
    parts = urlsplit(url)
    scheme, place = parts.scheme.lower(), (parts.hostname or "").lower()
    if parts.port and (scheme, parts.port) not in (("http", 80), ("https", 443)):
        place += f":{parts.port}"
    path = parts.path
    while "//" in path:
        path = path.replace("//", "/")
    path = path.rstrip("/") or "/"
    pairs = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in TRACKING_KEYS)
    query = "" if place.endswith("governmentjobs.com") and "/jobs/" in path.lower() else urlencode(pairs)
    return (f"{scheme}:" if scheme else "") + (f"//{place}" if place else "") + path + (f"?{query}" if query else "")


def test_canonical_urls_agree_with_the_standard_library(spark):
    rnd = random.Random(5)
    urls = [
        "https://boats.example.gov/post?post=7&utm_medium=card&tide=low#bow", "HTTPS://WWW.GOVERNMENTJOBS.COM/careers/yuma/jobs/77/pilot/?deck=2#bow", "", None, "  ",
        "https://xgovernmentjobs.com/a/jobs/1?q=1", "https://www.governmentjobs.com:8443/jobs/1?q=1", "http://u:p@h_1.gov:80/a//b/?b=2&a=%20x&a=~*&c",
    ]
    for _ in range(400):
        q = "&".join(rnd.choice(["a", "b=", "c=1", "utm_x=1", "REF=2", "d=%C3%A9", "e=a+b", "f=~*", "gclid=9", ""]) for _ in range(rnd.randint(0, 5)))
        urls.append(f"{rnd.choice(['http', 'HTTPS'])}://{rnd.choice(['', 'me@'])}{rnd.choice(['Ex.com', 'h_2.gov', 'a.governmentjobs.com'])}{rnd.choice(['', ':80', ':443', ':99'])}{rnd.choice(['', '/', '/a/B//c/', '/jobs/1/'])}{'?' + q if q else ''}{rnd.choice(['', '#f'])}")
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u"))).collect()]
    assert got == [plain_canonical(u) for u in urls]


@pytest.mark.parametrize("told, url, want", [("NeoGov ", "https://x.y", "neogov"), (None, "https://a.neogov.com/b", "neogov"), ("", "https://hcmprod.x.gov/", "peoplesoft"), (None, "https://Ex.org:99/a", "ex.org"), (None, "", "unknown")])
def test_platform_name(spark, told, url, want):
    df = spark.createDataFrame([(told, url)], "t string, u string")
    assert df.select(platform_name(F.col("t"), canonical_url(F.col("u")))).first()[0] == want


def test_detected_platform_and_host(spark):
    df = spark.createDataFrame([("https://WWW.GovernmentJobs.com/x",), ("https://hcmprod.a",), ("https://b.c",), (None,)], "u string")
    assert [tuple(r) for r in df.select(detected_platform(F.col("u")), host(F.col("u"))).collect()] == [("NeoGov", "www.governmentjobs.com"), ("PeopleSoft", "hcmprod.a"), (None, "b.c"), (None, "")]
