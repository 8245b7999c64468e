"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are runs of word characters of the lower-cased text. Every SEED_WORDS-gram of a test item is counted over all
documents. Grams of at most COMMON_DOCS documents, or of COMMON_SHARE of them, are rare: one of them leads from a passage to
its item. A common gram does so only with another gram of the item beside it (or if the item has fewer than FEW_GRAMS
grams), so that everyday phrases don't make every document a candidate. A pass over the documents finds the grams and
takes the passages around them, as long as the item and some slack (passages that overlap are one). A passage
that can't reach MIN_SCORE by the number of words it shares with an item isn't aligned with it, which loses nothing. The
others are aligned: MATCH, MISMATCH and GAP by word. The score is that of the best local alignment divided by the item's
score with itself; a document with a score of MIN_SCORE or more is contaminated. A copy isn't found, whatever its score,
if it keeps no SEED_WORDS words in a row of its item, or only one such run and that a common gram.

Test items go to the tasks in blocks of BLOCK_BYTES bytes of different texts at most (an item that is longer is a block of its
own); each block reads the documents twice, for the counts and for the passages, and its finds are a written table, so that the
driver and the tasks hold one block at a time, however many there are. Nothing is shuffled but counts of item
grams and one row for each passage and item that reach MIN_SCORE.

Defined results: null and empty texts are not contaminated; null items and items of fewer than SEED_WORDS words have
no seed and match nothing. A null doc_id is reported as null. Rows are told apart by doc_id and text, so repeated
rows give one result. Items of equal texts are aligned once and reported with each id; of rows that repeat an item's id
the best score counts. An empty table gives an empty result. `remove_contaminated` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, give_back, small_batches, table, written

SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
SLACK = 8
COMMON_DOCS, COMMON_SHARE, FEW_GRAMS = 50, 0.001, 4
BLOCK_BYTES = 4 << 20
BROADCAST_BYTES = 16 << 20
WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def local_score(a: np.ndarray, b: np.ndarray) -> int:
    """The best local alignment of two sequences of word numbers (a row of the table at a time)."""
    step = np.arange(len(b) + 1) * -GAP
    above, best = np.zeros(len(b) + 1, int), 0
    for x in a:
        row = np.maximum(above + GAP, 0)
        np.maximum(row[1:], above[:-1] + np.where(b == x, MATCH, MISMATCH), out=row[1:])
        above = np.maximum.accumulate(row + step) - step  # gaps along the row
        best = max(best, int(above.max()))
    return best


class Block:
    """Some test items of different texts: their word numbers and the grams that stand in them.

    Grams are 64-bit hashes of word numbers; a hash that two share only makes more candidates.
    """

    def __init__(self, items: list[tuple[str, list]]):
        self.ids = [i for _, i in items]
        texts = [words(t) for t, _ in items]
        self.number = {w: n for n, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.words = [np.array([self.number[w] for w in t], np.int64) for t in texts]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, own in enumerate(self.words):
            for at, gram in enumerate(self.grams(own)[0].tolist()):
                places[gram].append((item, at))
        self.sorted = np.array(sorted(places), np.uint64)
        of = list(map(places.__getitem__, self.sorted.tolist()))
        self.items = [sorted({item for item, _ in p}) for p in of]
        self.few = [len(own) - SEED_WORDS + 1 < FEW_GRAMS for own in self.words]
        self.bags = [list(Counter(own.tolist()).items()) for own in self.words]
        reach = [(max(at + self.slack(i) for i, at in p), max(len(self.words[i]) - at + self.slack(i) for i, at in p)) for p in of]
        self.before, self.after = np.array(reach, np.int64).reshape(-1, 2).T
        self.common = np.zeros(len(of), bool)

    def slack(self, item: int) -> int:
        return SLACK + len(self.words[item]) // 4

    def grams(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each gram, and whether all its words are in items."""
        n = len(numbers) - SEED_WORDS + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(SEED_WORDS):
            out = (out ^ (out >> np.uint64(31))) * _MIX + numbers[k : k + n].astype(np.uint64)
            known &= numbers[k : k + n] >= 0
        return out, known

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the items' grams stand, and which they are (places in sorted)."""
        grams, known = self.grams(numbers)
        at = np.flatnonzero(known)
        if not len(at) or not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of = np.minimum(np.searchsorted(self.sorted, grams[at]), len(self.sorted) - 1)
        hit = self.sorted[of] == grams[at]
        return at[hit], of[hit]

    def passages(self, numbers: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(start, end, grams) of the passages around the items' grams."""
        at, of = self.hits(numbers)
        if not len(at):
            return []
        start, end = np.maximum(at - self.before[of], 0), np.minimum(at + self.after[of], len(numbers))
        order = np.argsort(start, kind="stable")
        of, start, end = of[order], start[order], np.maximum.accumulate(end[order])
        cuts = np.r_[0, np.flatnonzero(start[1:] > end[:-1]) + 1, len(of)]
        return [(int(start[a]), int(end[b - 1]), np.unique(of[a:b]).tolist()) for a, b in zip(cuts[:-1], cuts[1:])]

    def candidates(self, grams: list[int]) -> list[int]:
        """The items that a rare gram, or two grams, or any gram of an item of few, lead to."""
        seeded = {item for g in grams if not self.common[g] for item in self.items[g]}
        if len(seeded) < len(self.ids):
            times = Counter(item for g in grams if self.common[g] for item in self.items[g])
            seeded.update(item for item, n in times.items() if n > 1 or self.few[item])
        return sorted(seeded)

    def scores(self, passage: np.ndarray, items: list[int], min_score: float) -> list[tuple[int, float]]:
        """(item id, score) of the items that the passage reaches min_score with."""
        have = Counter(passage.tolist())
        out = []
        for item in items:
            own = self.words[item]
            need = min_score * len(own)
            if sum(min(n, have[w]) for w, n in self.bags[item]) >= need:
                score = local_score(own, passage) / (MATCH * len(own))
                if score >= min_score:
                    out += [(i, score) for i in self.ids[item]]
        return out


def _counted(docs: DataFrame, block: Block) -> None:
    """Mark the block's common grams: by the number of all documents (rows) that hold each."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, rows = shared.value, 0
        times = np.zeros(len(b.sorted), np.int64)
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0).to_pylist():
                times[np.unique(b.hits(b.numbers(text))[1])] += 1
        held = np.flatnonzero(times)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held.tolist()], pa.int64()), pa.array([rows, *times[held].tolist()], pa.int64())], ["gram", "n"])

    found = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    # at most a row for each gram of the block, whose size is bounded
    counts = {r["gram"]: r["n"] for r in found.collect()}
    least = max(COMMON_DOCS, COMMON_SHARE * counts.get(-1, 0))
    block.common[[g for g, n in counts.items() if g >= 0 and n > least]] = True
    shared.destroy()


def _one_block(docs: DataFrame, items: list[tuple[str, list]], id_type: str, min_score: float) -> DataFrame:
    block = Block(items)
    _counted(docs, block)
    shared = docs.sparkSession.sparkContext.broadcast(block)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        for batch in batches:
            rows = []
            for doc_id, th, text in zip(batch["doc_id"].array, batch["th"].array, batch["text"]):
                numbers = b.numbers(text)
                for start, end, grams in b.passages(numbers):
                    rows += [(doc_id, th, i, s) for i, s in b.scores(numbers[start:end], b.candidates(grams), min_score)]
            yield pd.DataFrame(rows, columns=["doc_id", "th", "item_id", "score"])
        give_back()

    out = written(docs.mapInPandas(found, f"doc_id {kind}, th long, item_id {id_type}, score double"), "leaks")
    shared.destroy()
    return out


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, list]]]:
    """(text, ids) of the items in blocks of at most so many bytes of different texts and ids."""
    block, size = [], 0
    for row in items.where("text is not null").orderBy("text").toLocalIterator():
        again = bool(block) and block[-1][0] == row["text"]
        more = 16 if again else 16 + len(row["text"].encode())
        if block and size + more > block_bytes:
            yield block
            block, size, again = [], 0, False
        if again:
            block[-1][1].append(row["item_id"])
        else:
            block.append((row["text"], [row["item_id"]]))
        size += more
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, th (a hash of the text), item_id and score of every document and item that reach min_score.

    docs: doc_id, text. benchmark: item_id, text.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text")).where("text is not null")
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for block in _blocks(benchmark.select("item_id", F.col("text").cast("string").alias("text")), block_bytes):
        one = _one_block(rows, block, id_type, min_score)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, item_id {id_type}, score double")
    return out.groupBy("doc_id", "th", "item_id").agg(F.max("score").alias("score"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no test item is found in."""
    doc, th = fresh(docs, "_doc", "_th")
    gone = contaminated(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(doc), F.col("th").alias(th)).distinct()
    gone = written(gone, "contaminated")
    size = gone.agg(F.sum(F.coalesce(F.octet_length(F.col(doc).cast("string")), F.lit(0)) + 24)).first()[0] or 0
    return docs.join(F.broadcast(gone) if size <= BROADCAST_BYTES else gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)), "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("score"), 6).alias("score"))
