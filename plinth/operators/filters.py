"""Row predicates."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LOCATION_STOP_WORDS, has_all, or_empty, terms


def _joined(df: DataFrame, *names: str) -> Column:
    return F.concat_ws(" ", *(or_empty(F.col(c)) for c in names if c in df.columns))


def filter_jobs(jobs: DataFrame, title: str = "", location: str = "") -> DataFrame:
    """Rows with every title term in title and department, and every location term in location and city."""
    by_title = has_all(terms(F.lit(title)), terms(_joined(jobs, "title", "department")))
    by_place = has_all(terms(F.lit(location), LOCATION_STOP_WORDS), terms(_joined(jobs, "location", "city"), LOCATION_STOP_WORDS))
    return jobs.where(by_title & by_place)


def min_score(df: DataFrame, threshold: float, score: str = "match_score") -> DataFrame:
    return df.where(F.coalesce(F.col(score), F.lit(0.0)) >= F.lit(threshold))


def is_fresh(cached_at: Column, asof: datetime.datetime, max_age_hours: int | None = None, default_hours: int = 6) -> Column:
    """Younger than the limit (0 or None: the default); the future is fresh, what is no time isn't."""
    at = cached_at.try_cast("timestamp_ntz")
    limit = asof - datetime.timedelta(hours=max_age_hours or default_hours)
    return F.coalesce(at > F.lit(limit.isoformat(sep=" ")).cast("timestamp_ntz"), F.lit(False))


def age_hours(cached_at: Column, asof: datetime.datetime) -> Column:
    now = F.lit(asof.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", cached_at.try_cast("timestamp_ntz"), now) / F.lit(3.6e9)


def dismiss(jobs: DataFrame, gone: DataFrame, key: str = "job_id") -> DataFrame:
    """jobs without those whose key is in gone."""
    return jobs.join(gone.select(key).distinct(), key, "left_anti")


def profile_complete() -> Column:
    return (F.length("name") > 0) & (F.length("degree") > 0) & (F.size("interests") > 0) & (F.length("resume_text") > 0)


def valid_vector(vector: Column, dimensions: int) -> Column:
    return (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
