"""The whole search as one plan: fresh cache and stored pages, identities, filters, embedding, ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.documents import job_text
from ..operators.dedup import deduplicate_jobs, union_in_order
from ..operators.filters import filter_jobs
from ..operators.models import DIMENSIONS, Embed, embedded, hashed_words
from ..operators.observed import Progress
from ..operators.search import hybrid_search


@dataclass
class Request:
    resume_text: str
    title: str = ""
    location: str = ""
    keywords: list[str] = field(default_factory=list)
    top_k: int = 100
    min_score: float = 0.0
    limit: int = 20
    dimensions: int = DIMENSIONS


def search_jobs(cached: DataFrame, scraped: DataFrame, request: Request, embed: Embed | None = None, progress: Progress | None = None) -> DataFrame:
    """The best jobs for a request. cached and scraped: job tables with pos; cached rows win ties.

    Duplicates go and filters hold before anything is embedded, and only the nearest top_k are scored. progress
    gets the counts of the run: cached, scraped, unfiltered (different jobs) and retained (after the filters).
    """
    embed = embed or hashed_words(request.dimensions)
    seen = progress.at if progress else lambda rows, place: rows
    jobs = seen(deduplicate_jobs(union_in_order(seen(cached, "cached"), seen(scraped, "scraped"))), "unfiltered")
    wanted = seen(filter_jobs(jobs, request.title, request.location), "retained")
    for name in ("location", "city", "title", "department", "description", "requirements", "job_type"):
        if name not in wanted.columns:
            wanted = wanted.withColumn(name, F.lit(None).cast("string"))
    vectors = wanted.withColumn("document", job_text()).withColumn("embedding", embedded(F.col("document"), embed, request.dimensions))
    query = embed([request.resume_text])[0]
    found = hybrid_search(vectors, query, request.keywords, ["title", "description", "requirements"], "job_id", request.top_k)
    return found.where(F.col("match_score") >= request.min_score).orderBy(F.desc("score"), "pos").limit(request.limit)
