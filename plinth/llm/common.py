"""What the operators of this subpackage share: tables, the shared folder, batches, joins on hot keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20
HOT_PARTS, HOT_LEAST = 1000, 200


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, with the named columns only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def col(name: str) -> Column:
    """The column of exactly this name, dots and back ticks in it too."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset (tests, one machine) a temporary folder is set once for the context.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    kept = spark.sparkContext.getCheckpointDir()
    if not kept:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plinth-"))
        kept = spark.sparkContext.getCheckpointDir()
    return kept


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder and read again: its lineage ends there.

    The shuffle files of the query are deleted when it ends, as nothing else can use them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, most: int = ARROW_ROWS) -> None:
    """Python functions over whole texts get batches of so many rows or ARROW_BYTES bytes at most (settings of the session)."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= most:
        spark.conf.set(rows, str(most))
    if not 0 < int(spark.conf.get(size).rstrip("b")) <= ARROW_BYTES:
        spark.conf.set(size, f"{ARROW_BYTES}b")


def give_back() -> None:
    """At the end of a task: a Python worker is used again by later tasks, so what it freed goes back to the system."""
    try:
        pa.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df (in any case) has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame | None:
    """key and parts (2 or more) of the keys with more than 1 / HOT_PARTS of total rows; None if there is none.

    counts: one row a key with n, its number of rows; total: the sum of n. So they number less than HOT_PARTS,
    whatever the tables' size, and are a local table.
    """
    most = max(total // HOT_PARTS, HOT_LEAST)
    if total <= most:
        return None
    hot = counts.where(F.col(n) > most).select(key, F.ceil(F.col(n) / most).cast("int").alias("parts"))
    rows = hot.collect()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def join_spread(rows: DataFrame, others: DataFrame, key: str, hot: DataFrame | None, by: str) -> DataFrame:
    """The inner join of rows with others (few rows a key); a hot key's rows are dealt by a hash of column by, and its others repeated.

    No task gets more than about 1 / HOT_PARTS of the rows for one key, and only hot (see hot_keys) is broadcast.
    """
    if hot is None:
        return rows.join(others, key)
    part, parts = "_part", F.coalesce("parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(part, F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    repeated = others.join(F.broadcast(hot), key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(repeated, [key, part]).drop(part)


def sha256_text(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


