"""Joins: lookups, overlays and the splits of what is known from what isn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_empty, present

OVERLAY_FIELDS = ("description", "requirements", "location", "department", "salary", "posted_date", "closing_date", "job_type")


def lookup(rows: DataFrame, catalog: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """rows with the catalog's columns; an unknown key raises when its row is read, or drops the row."""
    known = catalog.withColumn("_known", F.lit(True))
    joined = rows.join(known, key, "left" if strict else "inner")
    if not strict:
        return joined.drop("_known")
    message = F.concat(F.lit("not in the catalog: "), or_empty(F.col(key)))
    checked = F.when(F.col("_known").isNull(), F.raise_error(message).cast("string")).otherwise(F.col(key))
    return joined.withColumn(key, checked).drop("_known")


def overlay(rows: DataFrame, details: DataFrame, key: str, fields: tuple[str, ...] = OVERLAY_FIELDS) -> DataFrame:
    """rows with the details' values where these aren't empty; rows without details stay."""
    named = details.select(key, *[F.col(f).alias(f"_d_{f}") for f in fields])
    joined = rows.join(named, key, "left")
    return joined.withColumns({f: F.coalesce(present(F.col(f"_d_{f}")), F.col(f)) for f in fields}).drop(*[f"_d_{f}" for f in fields])


def split_by(rows: DataFrame, is_known: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold and rows that don't (null: don't)."""
    known = F.coalesce(is_known, F.lit(False))
    return rows.where(known), rows.where(~known)


def memo_hits(rows: DataFrame, memo: DataFrame, key: str) -> DataFrame:
    return rows.join(memo, key, "left_semi")


def memo_misses(rows: DataFrame, memo: DataFrame, key: str) -> DataFrame:
    return rows.join(memo, key, "left_anti")
