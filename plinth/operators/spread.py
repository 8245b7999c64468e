"""Rows over all cores, before Python works on them."""

from __future__ import annotations

from pyspark.sql import DataFrame

TASKS_A_CORE = 4


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over all cores by keys that differ from row to row.

    A file is cut into tasks by its bytes, and never within a row group, so a million short rows may be one task. Where Python takes tenths
    of a millisecond for each of them, that task takes minutes while other cores wait; a shuffle of short rows costs seconds.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *keys)
