"""Vector search and hybrid ranking.

Exact: the query vector is one row, so it goes into the plan as a literal, each task keeps its k nearest
(TakeOrderedAndProject) and only those are merged. Nothing of the collection is broadcast or collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty, rounded_score

SEMANTIC, KEYWORD = 0.7, 0.3


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a vector of zeros."""
    return F.coalesce(F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))), F.lit(0.0))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def with_distance(vectors: DataFrame, query: list[float] | Column, vector: str = "embedding") -> DataFrame:
    q = query if isinstance(query, Column) else literal_vector(query)
    return vectors.withColumn("distance", 1 - cosine(F.col(vector), q))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str, vector: str = "embedding") -> DataFrame:
    """The k rows of the smallest cosine distance (ties: by key)."""
    return with_distance(vectors, query, vector).orderBy("distance", key).limit(k)


def keyword_ratio(keywords: list[str], *parts: Column) -> Column:
    """The share of the keywords (lower case, distinct) that the joined parts contain; 0 without keywords."""
    distinct = list(dict.fromkeys(k.lower() for k in keywords))
    if not distinct:
        return F.lit(0.0)
    text = F.lower(F.concat_ws(" ", *[or_empty(p) for p in parts]))
    hits = reduce(lambda a, b: a + b, [F.contains(text, F.lit(k)).cast("int") for k in distinct])
    return hits / F.lit(float(len(distinct)))


def hybrid_score(distance: Column, ratio: Column) -> Column:
    """Of 100; a missing distance counts as a similarity of one half."""
    return (SEMANTIC * F.coalesce(1 - distance, F.lit(0.5)) + KEYWORD * ratio) * 100


def hybrid_search(vectors: DataFrame, query: list[float], keywords: list[str], parts: list[str], key: str, top_k: int = 100, threshold: float = 0.0, vector: str = "embedding") -> DataFrame:
    """The nearest top_k, scored with the keywords, best first; the threshold is on the unrounded score."""
    near = nearest(vectors, query, top_k, key, vector)
    scored = near.withColumn("score", hybrid_score(F.col("distance"), keyword_ratio(keywords, *[F.col(p) for p in parts])))
    kept = scored.where(F.col("score") >= threshold).withColumn("match_score", rounded_score(F.col("score")))
    return kept.orderBy(F.desc("score"), "distance", key)


def ranked(df: DataFrame, order: str, n: int | None = None, min_score: float | None = None, score: str = "match_score") -> DataFrame:
    """Best first, ties in the order given, at most n."""
    out = df if min_score is None else df.where(F.coalesce(F.col(score), F.lit(0.0)) >= min_score)
    out = out.orderBy(F.desc(F.coalesce(F.col(score), F.lit(0.0))), order)
    return out if n is None else out.limit(n)
