"""How many distinct jobs a cache has, by sketches that merge: one a city in the manifest, so that no job is read for a total.

A sketch (HyperLogLog, 2 ** LG_K registers) has a fixed size whatever the city's; the union of cities' sketches counts a job
that several cities list once. The standard error is ERROR of the count; `total` tells the bounds of three of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 12
ERROR = 1.04 / math.sqrt(1 << LG_K)


def sketched(jobs: DataFrame, city: str, job_id: str) -> DataFrame:
    """city, job_count (rows) and ids, the sketch of its different job ids (null ids don't count)."""
    return jobs.groupBy(city).agg(F.count(F.lit(1)).alias("job_count"), F.hll_sketch_agg(F.col(job_id).cast("string"), LG_K).alias("ids"))


def replaced(manifest: DataFrame, new: DataFrame, city: str) -> DataFrame:
    """The manifest with the new cities' rows in place of their old ones."""
    return manifest.join(new.select(city), city, "left_anti").unionByName(new)


def total(manifest: DataFrame) -> DataFrame:
    """job_count, estimate (distinct ids over all cities), and the bounds lower and upper."""
    made = manifest.agg(F.coalesce(F.sum("job_count"), F.lit(0)).alias("job_count"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("ids")), F.lit(0)).alias("estimate"))
    bound = lambda sign: F.round(F.col("estimate") / (1 + sign * 3 * ERROR)).cast("long")
    return made.select("job_count", "estimate", bound(1).alias("lower"), bound(-1).alias("upper"))
