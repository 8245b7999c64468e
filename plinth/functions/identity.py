"""Stable identities of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalized, or_empty, present
from .urls import canonical_url, platform_name

UNIT = "\u001f"
STABLE_ID = "^job_[0-9a-f]{24}$"


def job_id_of(platform: Column, city: Column, identity: Column) -> Column:
    seed = F.concat_ws(UNIT, platform, F.coalesce(present(normalized(city)), F.lit("unknown")), identity)
    return F.concat(F.lit("job_"), F.substring(F.sha2(seed, 256), 1, 24))


def _field(df: DataFrame, *path: str) -> Column:
    """A column or nested field, null where the table lacks it."""
    kind, column = df.schema, F
    if path[0] not in df.columns:
        return F.lit(None).cast("string")
    column, kind = F.col(path[0]), df.schema[path[0]].dataType
    for name in path[1:]:
        if name not in getattr(kind, "names", ()):
            return F.lit(None).cast("string")
        column, kind = column[name], kind[name].dataType
    return column.cast("string")


def with_identity(jobs: DataFrame) -> DataFrame:
    """jobs with a canonical url (where there is one) and the job_id that url, source id or names give."""
    get = lambda *path: _field(jobs, *path)
    known = jobs.withColumn("_canonical", canonical_url(get("url")))  # a projection of its own, as the id needs it several times
    url = F.col("_canonical")
    old = F.when(~F.coalesce(get("job_id"), F.lit("")).rlike(STABLE_ID), get("job_id"))
    source = F.coalesce(*(present(normalized(x)) for x in (get("raw_data", "posting_id"), get("raw_data", "source_job_id"), get("source_job_id"), old)))
    names = F.concat_ws("|", *(normalized(get(c)) for c in ("title", "department", "location")))
    identity = F.coalesce(present(F.lower(url)), F.concat(F.lit("source:"), source), F.concat(F.lit("fallback:"), names))
    told = F.coalesce(present(get("raw_data", "platform")), present(get("platform")))
    return known.withColumns({"url": F.coalesce(present(url), or_empty(get("url"))), "job_id": job_id_of(platform_name(told, url), get("city"), identity)}).drop("_canonical")
