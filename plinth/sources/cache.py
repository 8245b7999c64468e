"""The cache of jobs: one folder a city with JSON files, and a manifest, so that empty results are known too.

Writes replace the folders of their own cities only (dynamic partition overwrite). Freshness takes an explicit time.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import or_empty
from ..operators.dedup import deduplicate_jobs
from ..operators.filters import age_hours, is_fresh
from ..schemas import CACHE_FILE


def city_key(city: Column) -> Column:
    return F.regexp_replace(F.lower(or_empty(city)), "[ /]", "_")


def file_name(city: Column) -> Column:
    return F.concat(F.lit("jobs_"), city_key(city), F.lit(".json"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Cache files, one JSON object each (city, cached_at, job_count, jobs); unreadable ones drop out."""
    files = spark.read.schema(CACHE_FILE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return files.where("cached_at is not null")


def jobs_of_files(files: DataFrame) -> DataFrame:
    """The jobs of cache files with identities (older files lack them), the best of each."""
    rows = files.select("cached_at", F.posexplode("jobs").alias("pos", "job")).select("job.*", F.col("pos").cast("long").alias("pos"))
    return deduplicate_jobs(rows)


def save(jobs: DataFrame, cities: DataFrame, path: str, asof: datetime.datetime) -> None:
    """jobs (with city and pos) and a manifest row for each of cities, those without jobs too."""
    unique = deduplicate_jobs(jobs).withColumn("city_key", city_key(F.col("city")))
    counts = unique.groupBy("city_key").agg(F.count(F.lit(1)).alias("job_count"))
    stamp = F.lit(asof.isoformat(sep=" ")).cast("timestamp_ntz")
    manifest = cities.select("city").distinct().withColumn("city_key", city_key(F.col("city"))).join(counts, "city_key", "left")
    manifest = manifest.select("city", stamp.alias("cached_at"), F.coalesce("job_count", F.lit(0)).alias("job_count"), "city_key")
    for df, name in ((unique, "jobs"), (manifest, "manifest")):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city_key").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, asof: datetime.datetime, max_age_hours: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The jobs of fresh cities, and the manifest's rows of fresh ones."""
    manifest = spark.read.parquet(f"{path}/manifest").where(is_fresh(F.col("cached_at"), asof, max_age_hours))
    jobs = spark.read.parquet(f"{path}/jobs")
    return jobs.join(manifest.select("city_key"), "city_key", "left_semi"), manifest


def clear(spark: SparkSession, path: str, city: str | None = None) -> None:
    """Delete a city's folders, or the whole cache."""
    jvm = spark._jvm
    key = "" if city is None else "/city_key=" + city.lower().replace(" ", "_").replace("/", "_")
    for name in ("jobs", "manifest"):
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}{key}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def summary(manifest: DataFrame, asof: datetime.datetime, max_age_hours: int | None = None) -> DataFrame:
    """city, job_count, age in hours (one decimal, 0 is null) and fresh of each city."""
    age = F.round(age_hours(F.col("cached_at"), asof), 1)
    return manifest.select("city", "job_count", F.nullif(age, F.lit(0.0)).alias("age_hours"), is_fresh(F.col("cached_at"), asof, max_age_hours).alias("fresh"))


def total_fresh(cities: DataFrame) -> DataFrame:
    return cities.agg(F.coalesce(F.sum(F.when(F.col("fresh"), F.col("job_count"))), F.lit(0)).alias("total_jobs"), F.avg(F.nullif("age_hours", F.lit(0.0))).alias("mean_age_hours"))
