"""The vector index as a table: (job_id, content_hash, document, embedding). It grows by what is missing.

A file set is only ever appended to; of rows of one job_id the one whose hash is asked for counts, so a text
that changes gets a new row and nothing is rebuilt. `compact` rewrites the folder without stale rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import job_text
from ..operators.models import DIMENSIONS, Embed, embedded, missing_embeddings
from ..schemas import EMBEDDING

COLUMNS = "job_id string, content_hash string, document string, embedding array<float>"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index, empty where nothing was written yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], COLUMNS)
    return spark.read.schema(COLUMNS).parquet(path)


def extend(jobs: DataFrame, path: str, embed: Embed, dimensions: int = DIMENSIONS, workers: int | None = None) -> None:
    """Embed and append the jobs (with job_id) whose text the index lacks; workers bounds the calls at once."""
    documents = jobs.select("job_id", job_text().alias("document")).dropDuplicates(["job_id"])
    missing = missing_embeddings(documents, read_index(jobs.sparkSession, path))
    missing = missing.repartition(workers) if workers else missing
    rows = missing.withColumn("embedding", embedded(F.col("document"), embed, dimensions).cast(EMBEDDING))
    rows.select("job_id", "content_hash", "document", "embedding").write.mode("append").parquet(path)


def vectors_of(jobs: DataFrame, path: str) -> DataFrame:
    """jobs with their embedding from the index (an inner join on id and text)."""
    keyed = jobs.withColumn("content_hash", F.md5(job_text().cast("binary")))
    return keyed.join(read_index(jobs.sparkSession, path).select("job_id", "content_hash", "embedding"), ["job_id", "content_hash"])


def compact(jobs: DataFrame, path: str, to: str) -> None:
    """A copy of the index with the rows of these jobs only."""
    vectors_of(jobs, path).select("job_id", "content_hash", job_text().alias("document"), "embedding").write.mode("overwrite").parquet(to)


def clear_index(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
