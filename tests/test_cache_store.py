"""A cache save is whole or isn't there."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from plinth.errors import CacheConflictError
from plinth.sources import cache_store as c

NOON = datetime.datetime(2024, 5, 1, 12)
SCHEMA = "title string, city string, url string, pos long"


def jobs(spark, *rows):
    return spark.createDataFrame([(t, city, f"https://e.gov/jobs/{t}", i) for i, (city, t) in enumerate(rows)], SCHEMA).repartition(3)


def cities(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "city string")


def read(spark, path, at=NOON, hours=6):
    found, manifest = c.read_committed(spark, path, SCHEMA + ", job_id string", at, hours)
    return sorted((r["city_key"], r["title"]) for r in found.collect()), sorted((r["city"], r["job_count"]) for r in manifest.collect())


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_save_and_replace(spark, tmp_path):
    path = str(tmp_path)
    assert read(spark, path) == ([], [])
    c.commit_jobs(jobs(spark, ("Tempe", "a"), ("Tempe", "b"), ("El Paso", "x"), ("Tempe", "a")), cities(spark, "Tempe", "El Paso", "Mesa"), path, NOON)
    assert read(spark, path) == ([("el_paso", "x"), ("tempe", "a"), ("tempe", "b")], [("El Paso", 1), ("Mesa", 0), ("Tempe", 2)])
    c.commit_jobs(jobs(spark, ("Tempe", "c")), cities(spark, "Tempe"), path, NOON + datetime.timedelta(hours=5))
    assert read(spark, path) == ([("el_paso", "x"), ("tempe", "c")], [("El Paso", 1), ("Mesa", 0), ("Tempe", 1)])
    assert read(spark, path, NOON + datetime.timedelta(hours=8)) == ([("tempe", "c")], [("Tempe", 1)])  # the others are stale
    before = len(files(path))
    assert c.vacuum(path) > 0 and len(files(path)) < before
    assert read(spark, path)[0] == [("el_paso", "x"), ("tempe", "c")]


def test_a_failing_task_leaves_all_cities_whole(spark, tmp_path):
    path = str(tmp_path)
    c.commit_jobs(jobs(spark, ("Tempe", "a"), ("Mesa", "m")), cities(spark, "Tempe", "Mesa"), path, NOON)
    kept, old = files(path), read(spark, path)
    bad = F.when(F.col("title") == "boom", F.raise_error(F.lit("lost"))).otherwise(F.col("title"))
    more = jobs(spark, *[("Tempe", f"new{i}") for i in range(50)], ("Mesa", "m2"), ("Mesa", "boom"), ("Nowhere", "n")).withColumn("title", bad)
    with pytest.raises(Exception, match="lost"):
        c.commit_jobs(more, cities(spark, "Tempe", "Mesa"), path, NOON)
    assert read(spark, path) == old and files(path) == kept


def test_a_commit_that_fails_deletes_its_files(spark, tmp_path):
    """Another save is committed while the tasks of this one write."""
    path = str(tmp_path)
    c.commit_jobs(jobs(spark, ("Tempe", "a")), cities(spark, "Tempe"), path, NOON)
    kept = files(path)

    @F.udf("string")
    def meddling(title):
        if title == "b" and c.snapshot(path)[0] == 1:
            c._Writer(path, "2024-05-01 13:00:00", 1).commit([c.Written({"mesa": "Mesa"}, {})])
        return title

    with pytest.raises(Exception, match="another save"):
        c.commit_jobs(jobs(spark, ("Tempe", "b"), ("Mesa", "m")).withColumn("title", meddling("title")), cities(spark, "Tempe"), path, NOON)
    assert [f for f in files(path) if f not in kept and "/data/" in f] == []
    assert read(spark, path) == ([("tempe", "a")], [("Mesa", 0), ("Tempe", 1)])


def test_two_saves_at_once(spark, tmp_path):
    path = str(tmp_path)
    first, second = c._Writer(path, "2024-05-01 12:00:00", 0), c._Writer(path, "2024-05-01 12:00:01", 0)
    first.commit([c.Written({"tempe": "Tempe"}, {}), None])
    with pytest.raises(CacheConflictError):
        second.commit([c.Written({"mesa": "Mesa"}, {})])
    assert [*c.snapshot(path)[1]] == ["tempe"]


def test_empty_tables_and_odd_names(spark, tmp_path):
    path = f"file:{tmp_path}"
    c.commit_jobs(jobs(spark).limit(0), cities(spark).limit(0), path, NOON)
    assert read(spark, path) == ([], [])
    c.commit_jobs(jobs(spark, (None, "a"), ("São Paulo/Centro", "b")), cities(spark, None, "MESA", "Mesa"), path, NOON)
    assert read(spark, path) == ([("", "a"), ("são_paulo_centro", "b")], [("", 1), ("Mesa", 0), ("São Paulo/Centro", 1)])
