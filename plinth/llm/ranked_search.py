"""Ranked lexical search: every item's best documents by sort-based accumulation of integer impacts.

Terms are the maximal runs of 0-9, A-Z, a-z and all characters beyond ASCII; A-Z count as a-z. One pass over
the texts writes an index of what the items' terms find: a row a document with its number of terms and the ids and
frequencies of those that items have. N, L and each term's df are counted over this table, so over all documents. Then
the index is dealt by ranges of doc_id, in parts of about PART_IMPACTS impacts. A task takes its range in chunks
of CHUNK_IMPACTS: every (document, term) becomes one impact for each item with the term, the impacts of a chunk lie
in one array with packed keys (item, document), a radix sort of the keys (stable, 16 bits a turn) brings a pair's
impacts together and `numpy.add.reduceat` sums them. A heap an item keeps the task's best; the tasks' best meet
in a last ranking of at most top * MAX_PARTS rows an item.

Items go in blocks of about BLOCK_TERMS (item, term) pairs, whole items each, one after the other: only one block's terms
are in the driver, broadcast and given back, and its result is a written table. A block is one scan of the texts; its impacts
cost far more than that.

Defined results: a null or empty text has no terms and doesn't count for N; an item without terms, or whose
terms no document holds, has no rows. Rows with one item_id are one item with all their terms. Rows with one doc_id are
documents of their own, and all may be ranked; a null doc_id counts as the largest. Ids are integers. Equal scores go by
ascending doc_id. Empty tables give an empty result; further columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, discard, give_back, small_batches, table, written

TOP = 50
BLOCK_TERMS = 300_000
PART_IMPACTS, CHUNK_IMPACTS, MAX_PARTS = 16_000_000, 2_000_000, 20_000
RUN_WORDS = 1_000_000
LAST_ID = 1 << 63

#: Bytes to bytes: A-Z in lower case, other ASCII than letters and digits as spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

INDEX = "doc_id long, n long, part long, ids array<int>, tfs array<int>"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded length."""
    rest = text.translate(_PLAIN)
    while rest:
        words = rest.split(None, RUN_WORDS)
        rest = words.pop() if len(words) > RUN_WORDS else b""
        yield words


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def radix_order(keys: np.ndarray, span: int) -> np.ndarray:
    """The stable order of keys below span, 16 bits a turn (numpy sorts 16-bit numbers by radix)."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    for shift in range(16, span.bit_length(), 16):
        digit = (keys >> np.uint64(shift)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


class Block:
    """The terms of one block of items: ids of terms, and the items of each term in one array."""

    def __init__(self, pairs: list[tuple[int | None, bytes]]):
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i or 0))
        at = {item: n for n, item in enumerate(self.items)}
        self.ids: dict[bytes, int] = {}
        for _, term in pairs:
            self.ids.setdefault(term, len(self.ids))
        both = np.array([(self.ids[t], at[i]) for i, t in pairs], dtype=np.int64).reshape(-1, 2)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        self.item_of = both[:, 1].copy()
        self.starts = np.searchsorted(both[:, 0], np.arange(len(self.ids) + 1))


def _matched(shared):
    """INDEX rows: what the block's terms find in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, row = shared.value.ids.get, 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, found = 0, Counter()
                for words in terms(text.as_py()):
                    n += len(words)
                    found.update(map(find, words))
                found.pop(None, None)
                row += 1
                if n:
                    out.append((doc_id, n, row, list(found), list(found.values())))
            columns = zip(*out) if out else [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n", "part", "ids", "tfs"])
        give_back()

    return run


class Accumulator:
    """The best documents of each item so far: chunks of documents are summed by sorting, heaps keep the best."""

    def __init__(self, block: Block, weights: np.ndarray, docs: int, words: int, top: int):
        self.block, self.weights, self.docs, self.words, self.top = block, weights, docs, words, top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in block.items]
        self.least = np.zeros(len(block.items), dtype=np.int64)
        self.spread = np.diff(block.starts)

    def add(self, doc_ids: list[int | None], n: list[int], ids: np.ndarray, tfs: np.ndarray, ends: np.ndarray) -> None:
        """Documents with their terms' ids and frequencies, those of document i at ends[i] to ends[i + 1]."""
        m = np.array([50 + 50 * x * self.docs // self.words for x in n], dtype=np.int64)
        held = np.concatenate([[0], np.cumsum(self.spread[ids])])[ends]  # impacts before each document
        at, last = 0, len(doc_ids)
        while at < last:
            to = max(at + 1, int(np.searchsorted(held, held[at] + CHUNK_IMPACTS, "right")) - 1)
            a, b = ends[at], ends[to]
            doc = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
            self._chunk(doc_ids[at:to], doc, ids[a:b], self.weights[ids[a:b]] * (1_000_000_000 * tfs[a:b] // (1000 * tfs[a:b] + 20 * m[at:to][doc])))
            at = to

    def _chunk(self, doc_ids: list[int | None], doc: np.ndarray, ids: np.ndarray, impact: np.ndarray) -> None:
        times = self.spread[ids]
        total = int(times.sum())
        if not total:
            return
        before = np.cumsum(times) - times
        item = self.block.item_of[np.arange(total) + np.repeat(self.block.starts[ids] - before, times)]
        keys = (item * len(doc_ids) + np.repeat(doc, times)).astype(np.uint64)
        order = radix_order(keys, len(self.block.items) * len(doc_ids))
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(np.repeat(impact, times)[order], first)
        item, doc = np.divmod(keys[first].astype(np.int64), len(doc_ids))
        good = (sums > 0) & (sums >= self.least[item])
        self._select(item[good], doc[good], sums[good], doc_ids)

    def _select(self, item: np.ndarray, doc: np.ndarray, sums: np.ndarray, doc_ids: list[int | None]) -> None:
        edges = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1], [True]])) if len(item) else []
        for a, b in zip(edges, edges[1:]):
            which, some, docs = int(item[a]), sums[a:b], doc[a:b]
            if b - a > self.top:
                chosen = some >= np.partition(some, -self.top)[-self.top]  # equal scores stay
                some, docs = some[chosen], docs[chosen]
            heap = self.heaps[which]
            for score, d in zip(some.tolist(), docs.tolist()):
                entry = (score, -(LAST_ID if doc_ids[d] is None else doc_ids[d]))
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[which] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        out = [(item, None if d == -LAST_ID else -d, score) for item, heap in zip(self.block.items, self.heaps) for score, d in heap]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 3)], ["item_id", "doc_id", "score"])


def _accumulated(shared, weights: np.ndarray, docs: int, words: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Accumulator(shared.value, weights, docs, words, top)
        for batch in batches:
            ids, tfs = batch.column(2), batch.column(3)
            ends = ids.offsets.to_numpy()
            best.add(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64), (ends - ends[0]).astype(np.int64))
        yield best.rows()
        give_back()

    return run


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """The different (item_id, term) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list({(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for words in terms(t) for w in words})
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([w for _, w in pairs], pa.binary())], ["item_id", "term"])

    return _texts(items, item_id, text).mapInArrow(run, "item_id long, term binary").distinct()


def _texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The ids and texts that aren't null, as id and text."""
    return rows.select(col(key).cast("long").alias("id"), col(text).cast("binary").alias("text")).where("text is not null")


def _best(texts: DataFrame, block: Block, top: int) -> DataFrame:
    """item_id, rank, doc_id and score for one block of items, as a written table."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(block)
    index = written(texts.mapInArrow(_matched(shared), INDEX), "search-index")
    docs, words = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(block.ids), dtype=np.int64)
    for term, n in index.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # the block's terms at most
        df[term] = n
    weights = np.array([weight(docs, int(n)) for n in df], dtype=np.int64)
    parts = min(max(1, -(-int((df * np.diff(block.starts)).sum()) // PART_IMPACTS)), MAX_PARTS)
    ranged = index.where("size(ids) > 0").repartitionByRange(parts, "doc_id", "part").select("doc_id", "n", "ids", "tfs")
    found = ranged.mapInArrow(_accumulated(shared, weights, docs, words or 1, top), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = written(ranked.select("item_id", "rank", "doc_id", "score"), "search-best")
    discard(index)
    shared.destroy()
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the top documents of every item."""
    spark = docs.sparkSession
    small_batches(spark)
    pairs = written(_item_terms(items, item_id, text), "search-terms")
    blocks = max(1, -(-pairs.count() // block_terms))
    texts, best = _texts(docs, doc_id, text), []
    for b in range(blocks):
        rows = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if rows or not b:
            best.append(_best(texts, Block([(r["item_id"], bytes(r["term"])) for r in rows]), top))
    discard(pairs)
    return reduce(DataFrame.unionByName, best)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
with d as (select doc_id, row, unnest({_TERMS}) as t from (select *, row_number() over () as row from documents)),
tf as (select doc_id, row, t, count(*) as tf from d group by all),
len as (select row, sum(tf)::bigint as n from tf group by row),
total as (select count(*)::bigint as docs, sum(n)::bigint as words from len),
q as (select distinct item_id, unnest({_TERMS}) as t from benchmark),
w as (select t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w from (select t, count(*) as df from tf group by t), total),
m as (select row, 100 - 50 + ((50 * n * docs) // words) as m from len, total),
s as (
  select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score
  from q join w using (t) join tf using (t) join m using (row) group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= {TOP}
"""
