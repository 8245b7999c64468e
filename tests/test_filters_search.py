import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plinth.functions.documents import job_text, keyword_overlap, profile_keywords, resume_text
from plinth.functions.text import LOCATION_STOP_WORDS, clean_text, fenced, html_escaped, rounded_score, score_badge, score_shown, terms
from plinth.operators.dedup import narrow_cities
from plinth.operators.filters import filter_jobs, is_fresh, valid_vector
from plinth.operators.joins import lookup, overlay
from plinth.operators.search import hybrid_score, hybrid_search, nearest
from plinth.plans.profile import new_profile, session_minutes, updated, with_defaults
from plinth.plans.search_jobs import Request, search_jobs
from plinth.schemas import PROFILE

JOBS = [
    ("Senior Software Engineer", "Information Technology", "Phoenix", "Phoenix, AZ", 0),
    ("Human Resources Analyst", "Human Resources", "Tempe", "City of Tempe, Arizona", 1),
    ("IT Support Specialist", "Technology Services", "Pima County", "Tucson, AZ", 2),
]


@pytest.fixture
def jobs(spark):
    return spark.createDataFrame(JOBS, "title string, department string, city string, location string, pos long")


@pytest.mark.parametrize("title, location, want", [("", "", [0, 1, 2]), ("software-engineer", "", [0]), ("human resources", "", [1]), ("", "Phoenix, Arizona", [0]), ("", "AZ", [0, 1, 2]), ("clerk", "", [])])
def test_filter_jobs(jobs, title, location, want):
    assert sorted(r["pos"] for r in filter_jobs(jobs, title, location).collect()) == want


@pytest.mark.parametrize("cities, place, want", [(["Phoenix", "Tempe", "Pima County"], "Pima County, AZ", ["Pima County"]), (["Phoenix", "Tempe"], "Tucson", ["Phoenix", "Tempe"]), (["Phoenix"], "", ["Phoenix"])])
def test_narrow_cities(spark, cities, place, want):
    df = spark.createDataFrame([(c,) for c in cities], "city string")
    assert sorted(r["city"] for r in narrow_cities(df, terms(F.lit(place), LOCATION_STOP_WORDS)).collect()) == want


def test_job_text_leaves_out_what_is_empty(spark):
    df = spark.createDataFrame([("T", "", None, "Tempe", "D", "", None)], "title string, department string, location string, city string, description string, requirements string, job_type string")
    assert df.select(job_text()).first()[0] == "Title: T\n\nLocation: Tempe\n\nDescription: D"


def test_resume_text_and_keywords(spark):
    parsed = Row(skills=["Python", "SQL"], experience=[Row(title="Dev", company="City", duration=None, description="built")], education=[Row(degree="BS", field="CS", institution="U", year=None)], projects=[Row(name="P", description="d", technologies=["a", "b"])], certifications=[], summary="", error=None, name=None)
    rows = [("n", "BS", ["sql", "Maps"], "r", "f", "Software Engineer", "Phoenix", parsed, None), ("n", "", [], "r", "f", "", "", None, None)]
    df = spark.createDataFrame(rows, PROFILE)
    got = [tuple(r) for r in df.select(resume_text(), profile_keywords()).collect()]
    assert got[0][0] == "Target role: Software Engineer\n\nPreferred location: Phoenix\n\nInterests: sql, Maps\n\nEducation: BS\n\nSkills: Python, SQL\n\nExperience:\nDev at City: built\n\nEducation Details:\nBS in CS from U\n\nProjects:\nP: d (Technologies: a, b)"
    assert got[0][1] == ["python", "sql", "maps"]
    assert got[1] == ("", [])


def test_keyword_overlap(spark):
    df = spark.createDataFrame([(["python", "zz"], "I use Python", None), ([], "x", "y")], "k array<string>, a string, b string")
    assert [r[0] for r in df.select(keyword_overlap(F.col("k"), F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]


@pytest.mark.parametrize("distance, ratio, want", [(0.2, 0.5, 71.0), (0.5, 0.0, 35.0), (1.2, 0.0, -14.0), (0.0, 1.0, 100.0), (0.35, 1 / 3, 55.5)])
def test_hybrid_score(spark, distance, ratio, want):
    assert spark.range(1).select(rounded_score(hybrid_score(F.lit(distance), F.lit(ratio)))).first()[0] == want


def test_rounding_by_the_exact_value(spark):
    df = spark.createDataFrame([(72.25,), (72.35,), (72.45,), (87.55,), (0.25,), (1234.56,)], "x double")
    assert [r[0] for r in df.select(rounded_score(F.col("x"))).collect()] == [round(x, 1) for x in (72.25, 72.35, 72.45, 87.55, 0.25, 1234.56)]


def test_nearest_gives_a_zero_vector_the_distance_one_and_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [-1.0, 0.0])], "id long, embedding array<float>")
    assert [(r["id"], r["distance"]) for r in nearest(df, [1.0, 0.0], 4, "id").collect()] == [(1, 0.0), (3, 0.0), (2, 1.0), (4, 2.0)]


def test_hybrid_search_drops_negative_scores(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], "x python"), ("b", [-1.0, 0.0], "y")], "job_id string, embedding array<float>, title string")
    got = hybrid_search(df, [1.0, 0.0], ["Python", "python"], ["title"], "job_id").collect()
    assert [(r["job_id"], r["match_score"]) for r in got] == [("a", 100.0)]


def test_badges_and_escapes(spark):
    df = spark.createDataFrame([("61.4",), ("59.6",), ("x",), (None,), ("40",)], "s string")
    assert [tuple(r) for r in df.select(score_badge(F.col("s")), score_shown(F.col("s"))).collect()] == [("high", "61/100"), ("med", "60/100"), ("low", "0/100"), ("low", "0/100"), ("med", "40/100")]
    assert spark.range(1).select(html_escaped(F.lit("<b>Tempe</b> & 'x\""))).first()[0] == "&lt;b&gt;Tempe&lt;/b&gt; &amp; &#x27;x&quot;"


def test_clean_text_knows_unicode_spaces(spark):
    assert spark.range(1).select(clean_text(F.lit(" a  b\x1cc\n"))).first()[0] == "a b c"


def test_fenced(spark):
    df = spark.createDataFrame([('```json\n{"a":1}\n```',), ('say ```\n{"a":2}``` so',), ('{"a":3}',)], "r string")
    assert [r[0] for r in df.select(fenced(F.col("r"))).collect()] == ['{"a":1}', '{"a":2}', '{"a":3}']


def test_freshness(spark):
    asof = datetime.datetime(2024, 1, 31, 12)
    df = spark.createDataFrame([("2024-01-31T06:00:00",), ("2024-01-31T06:00:01",), ("2025-01-01",), ("junk",), (None,)], "t string")
    assert [r[0] for r in df.select(is_fresh(F.col("t"), asof, 0)).collect()] == [False, True, True, False, False]


def test_lookup_raises_on_a_miss_and_overlay_keeps_rows(spark):
    rows = spark.createDataFrame([("a", "old"), ("z", "old")], "k string, description string")
    known = spark.createDataFrame([("a", 1)], "k string, n int")
    with pytest.raises(Exception, match="not in the catalog"):
        lookup(rows, known, "k").collect()
    assert lookup(rows, known, "k", strict=False).count() == 1
    found = spark.createDataFrame([("a", ""), ("b", "x")], "k string, description string")
    assert sorted(tuple(r) for r in overlay(rows, found, "k", ("description",)).collect()) == [("a", "old"), ("z", "old")]


def test_valid_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],)], "v array<float>")
    assert [r[0] for r in df.select(valid_vector(F.col("v"), 2)).collect()] == [True, False, False, False]


def test_search_embeds_only_what_passes_the_filters(spark, jobs):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        return [[1.0, 0.0] for _ in texts]

    more = jobs.withColumn("url", F.concat(F.lit("https://example.gov/jobs/"), F.col("pos").cast("string")))
    request = Request("engineer", title="software engineer", location="Phoenix, Arizona", dimensions=2)
    got = search_jobs(more.where("pos < 2"), more.where("pos = 2"), request, embed).collect()
    assert [(r["title"], r["match_score"]) for r in got] == [("Senior Software Engineer", 70.0)]


def test_profile(spark):
    asof = datetime.datetime(2024, 1, 1, 12)
    one = updated(new_profile(spark), asof, name="A", resume_text="text")
    two = updated(one, asof + datetime.timedelta(hours=1), degree="BS", resume_parsed=None)
    row = two.first()
    assert (row["name"], row["degree"], row["created_at"], row["resume_parsed"]) == ("A", "BS", asof, None)
    assert session_minutes(two, asof + datetime.timedelta(minutes=90, seconds=59)).first()[0] == 90
    assert with_defaults(one).first()["interests"] == ["Public Administration"]
    assert with_defaults(new_profile(spark)).count() == 0
