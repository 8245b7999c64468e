"""As-of join: each row with the version of its key that was the last one at its time.

Rows and versions of a key are one sorted sequence in which the last version is carried forward; no pair of a row and a version that
isn't its own is ever made. A key with more than 1 / HOT_PARTS of all rows (so less than HOT_PARTS keys) is cut into parts of equal
time; each part carries its own versions forward, and what a part begins with is the last version of the parts before it, which is
a sequence of one row a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_PARTS, HOT_LEAST = 1000, 10_000


def asof(rows: DataFrame, versions: DataFrame, key: str, at: str, version_at: str, values: list[str], tie: str, hot_least: int = HOT_LEAST) -> DataFrame:
    """rows with the columns values of the last version with version_at <= at; of versions at one time the one with the largest tie.

    A row before its key's first version, with a null key or without a time has nulls; versions without a key or a time don't count.
    """
    r, v = "_r", "_v"
    held = rows.select(F.struct(*rows.columns).alias(r))
    left = held.select(F.col(r)[key].alias("_key"), F.col(r)[at].cast("timestamp_ntz").alias("_at"), F.lit(1).alias("_side"), r)
    good = versions.where(F.col(key).isNotNull() & F.col(version_at).isNotNull())
    value = F.struct(*(F.col(c) for c in values), F.col(tie).alias("_tie"))
    right = good.select(F.col(key).alias("_key"), F.col(version_at).cast("timestamp_ntz").alias("_at"), F.lit(0).alias("_side"), value.alias(v))
    known = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    both = left.where(known).unionByName(right, allowMissingColumns=True)

    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "_at")
    counts = both.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("lo"), F.max(us).alias("hi"))
    total = both.count()
    most = max(total // HOT_PARTS, hot_least)
    hot = counts.where(F.col("n") > most).select("_key", "lo", "hi", F.ceil(F.col("n") / most).alias("parts"))  # less than HOT_PARTS rows
    dealt = both.join(F.broadcast(hot), "_key", "left")
    part = F.coalesce(F.floor((us - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.col("parts")), F.lit(0)).cast("long")
    dealt = dealt.select("_key", part.alias("_part"), "_at", "_side", r, v)

    order = Window.partitionBy("_key", "_part").orderBy("_at", "_side", F.col(v)["_tie"])
    carried = dealt.withColumn("_own", F.last(v, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.when(F.col("_side") == 0, F.struct("_at", F.col(v)["_tie"].alias("tie")))
    ends = dealt.groupBy("_key", "_part").agg(F.max_by(v, place).alias("_end"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("_key", "_part", F.last("_end", ignorenulls=True).over(before).alias("_begin")).where("_part > 0 and _begin is not null")
    found = carried.where("_side = 1").join(begins, ["_key", "_part"], "left").select(r, F.coalesce("_own", "_begin").alias(v))
    rest = left.where(~known).select(r, F.lit(None).cast(found.schema[v].dataType).alias(v))
    return found.unionByName(rest).select(f"{r}.*", *(F.col(v)[c].alias(c) for c in values))
