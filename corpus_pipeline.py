"""A training corpus from raw documents in five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage's decisions take effect: rejected documents go, and removed lines are gone from text
(n_chars follows the text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.bpe_codec import digests
from plinth.llm.common import col, discard, fresh, table, written
from plinth.llm.decontaminate import remove_contaminated
from plinth.llm.line_dedup import drop_boilerplate
from plinth.llm.minhash_near_dedup import STAGE_PERCENT, keep_first
from plinth.llm.quality_rules import clean


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the text that is left (null text: as it was)."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines."""
    text, kept = fresh(docs, "clean_text", "kept")
    judged = clean(docs, names=(text, kept)).where(col(kept))
    return _measured(judged.select(*[col(text if c == "text" else c).alias(c) for c in docs.columns]))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; a document that was all boilerplate stays, empty."""
    return _measured(drop_boilerplate(docs, names=tuple(fresh(docs, "n_lines", "n_dropped"))).select(*map(col, docs.columns)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (STAGE_PERCENT or more), that of the smallest doc_id."""
    return keep_first(docs, STAGE_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item is found in."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and digests of what is left."""
    return digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", encoding),
]

#: Alignment and byte-pair encoding aren't SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            made = written(made, f"stage-{k}")
            if k:
                discard(docs)  # the stage before it
        docs = made
    return docs
