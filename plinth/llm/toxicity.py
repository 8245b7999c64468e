"""Toxicity by compression distance between two zstandard dictionaries.

Training (driver, on a bounded sample of labelled rows: of the texts of at most MAX_TRAIN_CHARS characters the first
MAX_ROWS of each class in the order of a hash of doc_id):

1. An ordinary dictionary is trained on the windows of ordinary texts (at most MAX_WINDOWS of the sample's, drawn at
   random with a fixed seed).
2. A dictionary of all windows of toxic texts is mostly one of ordinary words and finds little (figures in the README), so
   the toxic one is trained on what only toxic texts have. Byte grams that toxic texts hold RATIO times as often as ordinary ones, in MIN_CONTEXTS
   different contexts or more (so that copies of one text count once), mark the toxic snippets;
   the toxic dictionary is trained on those. It is used together with the ordinary one, so both
   sides know ordinary words equally well and only toxic material makes a difference.
3. A window's advantage is its compressed length with the ordinary dictionary less that with both.
   A text's five advantages (largest, mean of the three largest, windows won by HIT bytes or
   more, their share, mean) go to a logistic function. It is fitted on texts that the
   dictionaries of the other half of the sample score, and its threshold is set where F1 is best.

Scoring takes every window of every whole text; labels, lang, source and doc_id are no inputs.

Defined results: null and empty texts have no window and get the function's value for zero
advantages. A repeated label row counts once; contradicting labels of a document count as toxic;
null labels are no labels. If a class has fewer than MIN_CLASS sample texts, every score is the
share of toxic texts in the sample (0 without any). An empty table gives an empty one.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, table

MAX_ROWS = 2000
MAX_TRAIN_CHARS = 20_000
CHUNK = 100
WINDOW_BYTES = 40
GRAM = 6
CONTEXT = 8
RATIO = 6.0
MIN_CONTEXTS = 6
PAD = 1
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
MAX_WINDOWS = 30_000
LEVEL = 3
HIT = 3
MIN_CLASS = 8
FOLDS = 4


def prepared(text: str | None) -> bytes:
    words = (text or "").lower().split()
    return f" {' '.join(words)} ".encode() if words else b""


def windows(raw: bytes) -> list[bytes]:
    """Pieces of WINDOW_BYTES or a little more that end at spaces; together they are the text."""
    out, at, last = [], 0, len(raw) - 1
    while at < last:
        end = raw.find(b" ", at + WINDOW_BYTES)
        end = last if end < 0 else end
        out.append(raw[at : end + 1])
        at = end
    return out


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every gram with its context in the texts: the gram's bytes and the context's as numbers, the gram's place."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int32)
    n = len(raw) - GRAM - CONTEXT + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int32),)
    context, gram = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for width, code, start in ((CONTEXT, context, 0), (GRAM, gram, CONTEXT)):
        for k in range(start, start + width):
            code <<= np.uint64(8)
            code |= raw[k : k + n]
    at = np.arange(n, dtype=np.int32)
    inside = at + (CONTEXT + GRAM) <= ends[np.searchsorted(ends, at, side="right")]
    return gram[inside], context[inside], at[inside] + np.int32(CONTEXT)


def _contexts(gram: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different grams, and in how many different contexts each stands."""
    pair = (context ^ context >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) ^ gram * np.uint64(0xC2B2AE3D27D4EB4F)
    _, first = np.unique(pair, return_index=True)
    return np.unique(gram[first], return_counts=True)


def toxic_snippets(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The runs of marking grams in toxic texts, each with PAD bytes around."""
    gram, context, place = _codes(toxic)
    kinds, counts = _contexts(gram, context)
    kinds, counts = kinds[counts >= MIN_CONTEXTS], counts[counts >= MIN_CONTEXTS]
    seen = []
    for i in range(0, len(ordinary), CHUNK):
        gram0, context0, _ = _codes(ordinary[i : i + CHUNK])
        likely = np.isin(gram0, kinds)
        seen.append((gram0[likely], context0[likely]))
    kinds0, counts0 = _contexts(np.concatenate([g for g, _ in seen]), np.concatenate([c for _, c in seen]))
    other = np.zeros(len(kinds))
    other[np.searchsorted(kinds, kinds0)] = counts0
    share = sum(map(len, toxic)) / max(1, sum(map(len, ordinary)))
    marks = place[np.isin(gram, kinds[counts + 0.5 >= RATIO * share * (other + 0.5)])]
    if not len(marks):
        return []
    cuts = np.flatnonzero(np.diff(marks) > 1)
    raw = b"".join(toxic)
    starts, stops = marks[np.r_[0, cuts + 1]], marks[np.r_[cuts, len(marks) - 1]] + GRAM
    return [raw[max(0, a - PAD) : b + PAD] for a, b in zip(starts.tolist(), stops.tolist())]


def _trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of the samples; the samples' own end where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    plain = [w for raw in ordinary for w in windows(raw)]
    plain = random.Random(0).sample(plain, MAX_WINDOWS) if len(plain) > MAX_WINDOWS else plain
    return _trained(plain, ORDINARY_BYTES), _trained([s * 2 for s in toxic_snippets(toxic, ordinary)], TOXIC_BYTES)


def _compressor(raw: bytes) -> Callable[[bytes], bytes]:
    known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def advantages(ordinary: bytes, toxic: bytes) -> Callable[[bytes], list[float]]:
    """From a prepared text to its five features."""
    plain, both = _compressor(ordinary), _compressor(ordinary + toxic)

    def of(raw: bytes) -> list[float]:
        won = [len(plain(w)) - len(both(w)) for w in windows(raw)]
        if not won:
            return [0.0] * 5
        top, hits = sorted(won, reverse=True)[:3], sum(x >= HIT for x in won)
        return [min(top[0], 12) / 5, min(sum(top) / 3, 12) / 5, math.log1p(hits), min(20 * hits / len(won), 3), sum(won) / len(won)]

    return of


def _logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    a = np.c_[np.ones(len(features)), features]
    w, keep = np.zeros(a.shape[1]), ridge * weights.sum() * np.eye(a.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weights * p * (1 - p))[:, None]).T @ a + keep, a.T @ (weights * (p - labels)) + keep @ w)
        w -= step
        if abs(step).max() < 1e-6:
            break
    return w


def _best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Midway between the two values where F1 is best."""
    order = np.argsort(-logits, kind="stable")
    weight, hit = weights[order], (weights * labels)[order]
    f1 = 2 * np.cumsum(hit) / (np.cumsum(weight) + hit.sum())
    k = int(f1.argmax())
    after = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float(logits[order[k]] + after) / 2


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None
    share: float

    def scorer(self) -> Callable[[str | None], float]:
        if self.weights is None:
            return lambda text: self.share
        features, w = advantages(self.ordinary, self.toxic), self.weights.tolist()

        def score(text: str | None) -> float:
            x = w[0] + sum(a * b for a, b in zip(w[1:], features(prepared(text))))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

        return score


def fit(rows: list[tuple[str | None, int]], toxic_share: float | None = None) -> Model:
    """A model from (text, label) rows; equal texts count once.

    toxic_share is that of all labelled rows, if the sample has another.
    """
    toxic = list(dict.fromkeys(p for t, y in rows if y and (p := prepared(t))))
    ordinary = list(dict.fromkeys(p for t, y in rows if not y and (p := prepared(t))))
    total = len(toxic) + len(ordinary)
    if min(len(toxic), len(ordinary)) < MIN_CLASS:
        return Model(b"", b"", None, len(toxic) / total if total else 0.0)
    features, labels = [], []
    for fold in range(FOLDS):
        of = advantages(*dictionaries([x for i, x in enumerate(toxic) if i % FOLDS != fold], [x for i, x in enumerate(ordinary) if i % FOLDS != fold]))
        for texts, label in ((toxic[fold::FOLDS], 1), (ordinary[fold::FOLDS], 0)):
            features += map(of, texts)
            labels += [label] * len(texts)
    x, y = np.array(features), np.array(labels, float)
    share = len(toxic) / total if toxic_share is None else toxic_share
    weights = np.where(y == 1, share / len(toxic), (1 - share) / len(ordinary)) * total
    w = _logistic(x, y, weights)
    w[0] -= _best_threshold(np.c_[np.ones(len(x)), x] @ w, y, weights)
    return Model(*dictionaries(toxic, ordinary), w, share)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 0 when divided by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[tuple[str, int]], float | None]:
    """The bounded sample, (text, toxic) of rows that aren't held out, and the toxic share of all such labels."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select("doc_id", "text").where(F.length("text") <= MAX_TRAIN_CHARS)
    there = texts.select("doc_id").distinct().join(known, "doc_id")
    picked = None
    for label in (1, 0):
        some = there.where((F.col("toxic") != 0) == bool(label)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = some if picked is None else picked.unionByName(some)
    rows = texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * max_rows)
    share = known.agg(F.avg((F.col("toxic") != 0).cast("double"))).first()[0]
    return [(r["text"], int(r["toxic"] != 0)) for r in rows.select("text", "toxic").collect()], share


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = model.scorer()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [of(t) for t in batch["text"]]})
        give_back()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(scored, f"doc_id {kind}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(*training_rows(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
