from pyspark.sql import functions as F

from plinth.functions.text import stripped
from plinth.operators.models import hashed_words
from plinth.plans.profile import candidate_name, new_profile, store
from plinth.sources import index

JOB = "job_id string, title string, department string, location string, city string, description string, requirements string, job_type string"


def jobs(spark, *rows):
    return spark.createDataFrame([(i, t, "", "", "", "", "", "") for i, t in rows], JOB)


def test_index_grows_by_what_is_missing(spark, tmp_path):
    path, asked = str(tmp_path / "index"), spark.sparkContext.accumulator(0)

    def embed(texts):
        asked.add(len(texts))
        return hashed_words(16)(texts)

    assert index.read_index(spark, path).count() == 0
    index.extend(jobs(spark, ("1", "a"), ("2", "b")), path, embed, 16)
    now = jobs(spark, ("1", "a"), ("2", "changed"), ("3", "c"))
    index.extend(now, path, embed, 16, workers=2)
    assert asked.value == 4 and index.read_index(spark, path).count() == 4
    assert sorted(r["job_id"] for r in index.vectors_of(now, path).collect()) == ["1", "2", "3"]
    index.compact(now, path, path + "2")
    assert index.read_index(spark, path + "2").count() == 3
    index.clear_index(spark, path)
    assert index.read_index(spark, path).count() == 0


def test_store_and_small_projections(spark):
    one = jobs(spark, ("", "Police Officer"), ("", "Police Officer")).withColumn("url", F.lit("https://example.gov/jobs/100")).withColumn("pos", F.lit(0))
    store(one, "kept_jobs")
    assert spark.table("kept_jobs").count() == 1
    assert candidate_name(new_profile(spark)).first()[0] == ""
    assert spark.range(1).select(stripped(F.lit("  04/01/2026 "))).first()[0] == "04/01/2026"
