"""Deduplication, fingerprints and other aggregates over records."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.identity import with_identity
from ..functions.text import or_empty

QUALITY_FIELDS = ("description", "requirements", "department", "salary")


def quality_key(df: DataFrame) -> Column:
    """(match score, length of the fields that describe a job); what is no number, NaN too, scores 0."""
    score = F.coalesce(F.col("match_score").try_cast("double"), F.lit(0.0)) if "match_score" in df.columns else F.lit(0.0)
    size = sum((F.length(or_empty(F.col(c))) for c in QUALITY_FIELDS if c in df.columns), F.lit(0))
    return F.struct(F.when(F.isnan(score), 0.0).otherwise(score).alias("score"), size.alias("size"))


def best_by_key(df: DataFrame, key: str, quality: Column, order: str) -> DataFrame:
    """The best row of each key (ties: the first), each with the key's first place in order.

    An aggregation with partial results: a key with very many rows costs each task one. As its rows are of variable size Spark
    sorts by the key for it.
    """
    row = F.struct(*df.columns)
    picked = df.groupBy(key).agg(F.max_by(row, F.struct(quality.alias("q"), -F.col(order))).alias("_row"), F.min(order).alias("_first"))
    rest = [F.col("_row")[c].alias(c) for c in df.columns if c != order]
    return picked.select(*rest, F.col("_first").alias(order))


def first_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def deduplicate_jobs(jobs: DataFrame, order: str = "pos") -> DataFrame:
    """Records with identities, the best of each job_id."""
    known = with_identity(jobs)
    return best_by_key(known, "job_id", quality_key(known), order)


def fingerprint(ids: Column) -> Column:
    """An aggregate: md5 of the distinct ids, sorted and joined by |. Ids only: contents don't count. For groups that fit a task (a city's jobs); else `fingerprints`."""
    return F.md5(F.array_join(F.array_sort(F.collect_set(ids)), "|"))


def fingerprints(rows: DataFrame, key: str, ids: str) -> DataFrame:
    """key and fingerprint of every key, as `fingerprint` gives it, without an array of a key's ids: they are sorted and fed to the hash one by one.

    A key's distinct ids pass through one task, as an md5 is a sequence, but none holds more than a batch of them. Null ids don't count.
    """
    kind = rows.schema[key].dataType
    plain = rows.select(F.col(key).alias("key"), F.col(ids).cast("string").alias("id")).distinct()
    ordered = plain.repartition("key").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, began, seen, digest = None, False, False, hashlib.md5(usedforsecurity=False)
        for batch in batches:
            done: list[tuple] = []
            for own, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not began or own != now:
                    done += [(now, digest.hexdigest())] if began else []
                    now, began, seen, digest = own, True, False, hashlib.md5(usedforsecurity=False)
                if one is not None:
                    digest.update(b"|" * seen + one.encode())
                    seen = True
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], batch.schema.field(0).type), pa.array([d for _, d in done], pa.string())], ["key", "fingerprint"])
        if began:
            yield pa.RecordBatch.from_arrays([pa.array([now], to_arrow_type(kind)), pa.array([digest.hexdigest()])], ["key", "fingerprint"])

    return ordered.mapInArrow(run, StructType([StructField("key", kind), StructField("fingerprint", StringType())])).withColumnRenamed("key", key)


def union_in_order(*parts: DataFrame, order: str = "pos") -> DataFrame:
    """All rows; those of an earlier table come first, and by order within a table."""
    out = None
    for rank, part in enumerate(parts):
        tagged = part.withColumn(order, F.struct(F.lit(rank).alias("source"), F.col(order).cast("long").alias("pos")))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    place = F.col(order)["source"].cast("long") * F.lit(1 << 40) + F.col(order)["pos"]
    return out.withColumn(order, place)


def narrow_cities(cities: DataFrame, wanted: Column, name: str = "city") -> DataFrame:
    """Cities that hold every wanted term; all of them if none does (which is asked while the plan is built)."""
    from ..functions.text import has_all, terms

    hits = cities.where(has_all(wanted, terms(F.col(name))))
    return cities if hits.isEmpty() else hits
