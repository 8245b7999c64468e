"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct WORDS-word shingles, over words of anything but space and
\\x09-\\x0D with A-Z in lower case (fewer words: the whole sequence; no word: nothing, linked with nothing).
Documents are linked if 100 * intersection >= percent * union of their sets; percent is STAGE_PERCENT, as in the
pipeline, unless the caller names another; the op10_ query links at PERCENT.

1. One pass makes the SHA-256 of each full set (its shingles as text, sorted), their number, and a signature of HASHES minima.
   Documents with equal digests have equal sets: one class from here on, named by its smallest doc_id.
2. Classes are candidates if one of BANDS bands of ROWS minima is equal. A pair at the threshold is
   missed with a probability of (1 - 0.85 ** ROWS) ** BANDS, 6e-9 (5e-6 at 80 percent).
3. Candidate pairs of a similar size are compared batch by batch of BATCH minima and pruned
   once the posterior probability of a similarity at the threshold is below MISS.
4. The rest is confirmed on the full sets, from the texts.

Not all pairs of a bucket are formed. First each class is held against one hub, the first member of its
largest bucket. Then only buckets that still hold several components go on; of buckets with the same
members one does, and a pair is compared in the first of its buckets. Their members are dealt into blocks (at most BLOCK classes and BLOCK_SHINGLES shingles on average), and two
blocks of a bucket meet in one task. It compares signatures in memory and names the members that have a pair to confirm;
no pair is a row. Texts go only to those members, and the same blocks confirm them and give only links that unite
components. Pairs within a component can't change the result.

Keys with very many rows (buckets, hubs, nodes) are dealt over tasks (join_spread).

Defined results: a null doc_id has no component (null) and is kept; rows that repeat a doc_id are
one document with the links of all. An empty table gives an empty one. Further columns pass through
`keep_first`, which keeps one document of each component.

The operator runs its jobs while the plan is built; its large intermediate tables are deleted once nothing reads them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, give_back, hot_keys, join_spread, small_batches, table, written
from .components import components

WORDS = 5
PERCENT = 85
STAGE_PERCENT = 80
ROWS, BANDS = 6, 40
HASHES = ROWS * BANDS
BATCH = 40
MISS = 1e-6
BLOCK, BLOCK_SHINGLES = 512, 200_000
CACHED_WORDS = 200_000
BROADCAST_IDS = 2_000_000  # of 8 bytes each

_RANDOM = np.random.default_rng(20240501)
_XOR = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ODD = np.array([int(x) | 1 for x in _RANDOM.integers(0, 1 << 63, WORDS, dtype=np.uint64)], np.uint64)
_KNOWN: dict[bytes, int] = {}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    """The exact set of a text."""
    w = words(text)
    return set(zip(*(w[k:] for k in range(WORDS)))) if len(w) >= WORDS else {tuple(w)} if w else set()


def linked(a: set, b: set, percent: int = STAGE_PERCENT) -> bool:
    small, large = sorted((a, b), key=len)
    if not small or 100 * len(small) < percent * len(large):
        return False
    both = len(small & large)
    return 100 * both >= percent * (len(small) + len(large) - both)


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def hashed_set(text: str | None) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    if len(_KNOWN) > CACHED_WORDS:
        _KNOWN.clear()
    for x in set(w).difference(_KNOWN):
        _KNOWN[x] = _word_hash(x)
    codes = np.fromiter(map(_KNOWN.__getitem__, w), np.uint64, len(w))
    if len(w) < WORDS:
        codes = np.r_[codes, np.full(WORDS - len(w), len(w), np.uint64)]
    n = len(codes) - WORDS + 1
    h = np.zeros(n, np.uint64)
    for k in range(WORDS):
        h += codes[k : k + n] * _ODD[k]
        h ^= h >> np.uint64(29)
    return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))


def _digest_of(text: str | None) -> tuple[int, bytes]:
    """The number of a text's distinct shingles, and the SHA-256 of them all."""
    w = words(text)
    found = set(map(b" ".join, zip(*(w[k:] for k in range(WORDS))))) if len(w) >= WORDS else {b" ".join(w)} if w else set()
    return len(found), hashlib.sha256(b"\n".join(sorted(found))).digest()


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima (their upper 16 bits) of each set; sets aren't empty."""
    flat = np.concatenate(sets)
    x = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], starts) >> np.uint32(16)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [hashed_set(t) for t in batch.column(1).to_pylist()]
        full = [s for s in sets if len(s)]
        made = iter(signatures(full)) if full else iter(())
        exact = [_digest_of(t) for t in batch.column(1).to_pylist()]
        sig = [next(made).tobytes() if len(s) else b"" for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in exact], pa.int64()), pa.array([h for _, h in exact], pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n", "h", "sig"])
    _KNOWN.clear()
    give_back()


def least_matches(n: int, percent: int = STAGE_PERCENT, miss: float = MISS) -> int:
    """The fewest matches of n for which the posterior P(similarity >= threshold), from a flat prior, is miss or more."""
    p, below = percent / 100, 0.0
    for m in range(n + 1):  # P(Beta(m + 1, n - m + 1) >= p) = P(Binomial(n + 1, p) <= m)
        below += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


Steps = list[tuple[int, int]]


def pruning_steps(percent: int) -> Steps:
    """How many minima are compared by the end of each batch, and how many of them have to match."""
    return [(n, least_matches(n, percent)) for n in range(BATCH, HASHES + 1, BATCH)]


def _outlive(left: np.ndarray, right: np.ndarray, steps: Steps) -> np.ndarray:
    """Whether pairs of signatures outlive every batch; left is a signature for each of right's, or one for all."""
    left = np.broadcast_to(left, right.shape)
    alive, matches = np.arange(len(right)), np.zeros(len(right), int)
    for n, least in steps:
        matches[alive] += (left[alive, n - BATCH : n] == right[alive, n - BATCH : n]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(right), bool)
    out[alive] = True
    return out


def _confirmed(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """The pairs a, b whose signatures outlive every batch and whose full sets are linked."""
    hub, of_hub, steps = None, set(), pruning_steps(percent)
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, HASHES) for c in ("sa", "sb"))
        alive = batch[_outlive(left, right, steps)]
        good = []
        for b, x, y in zip(alive["b"], alive["ta"], alive["tb"]):
            if (b, y) != hub:  # rows that repeat an id may have other texts
                hub, of_hub = (b, y), shingles(y)
            good.append(linked(shingles(x), of_hub, percent))
        yield alive.loc[good, ["a", "b"]]
    give_back()


def _similar_size(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _band(key: str) -> Column:
    """A bucket's band, which its key's lowest bits hold."""
    return F.col(key).bitwiseAND(F.lit(63))


class _Candidates:
    """The buckets of the classes, and what their members are held against."""

    def __init__(self, classes: DataFrame, docs: DataFrame, percent: int):
        self.percent = percent
        hashed = lambda i: F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))
        bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: hashed(i).bitwiseAND(F.lit(-64)).bitwiseOR(i.cast("long")))
        keys = classes.select("rep", "n", F.explode(bands).alias("key"))
        counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("hub"), F.min_by("n", "rep").alias("hub_n")).where("c > 1")
        counts = written(counts, "counts")
        self.hot = hot_keys(counts, "key", "c", counts.agg(F.sum("c")).first()[0] or 0)
        self.keys = written(join_spread(keys, counts, "key", self.hot, "rep"), "buckets")
        ids = written(self.keys.select(F.col("rep").alias("doc_id")).distinct(), "ids")
        few = ids.count() <= BROADCAST_IDS
        texts = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
        self.texts = written(texts.withColumnRenamed("doc_id", "rep").join(classes.select("rep", "sig"), "rep"), "texts")
        discard(counts, ids)

    def stars(self) -> DataFrame:
        """Links between classes and hubs, one pair at most for each class; written. A hub's pairs are dealt over tasks."""
        near = self.keys.where((F.col("rep") != F.col("hub")) & _similar_size(F.col("n"), F.col("hub_n"), self.percent))
        pairs = written(near.groupBy(F.col("rep").alias("a")).agg(F.max(F.struct("c", "hub")).alias("m")).select("a", F.col("m.hub").alias("b")), "pairs")
        hot = hot_keys(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")), "b", "c", pairs.count())
        own = self.texts.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("text").alias("ta"))
        of_hub = self.texts.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("text").alias("tb"))
        both = join_spread(pairs.join(own, "a"), of_hub, "b", hot, "a")
        out = written(both.mapInPandas(partial(_confirmed, percent=self.percent), "a long, b long"), "links")
        discard(pairs)
        return out

    def rest(self, found: DataFrame) -> DataFrame | None:
        """Links across components within buckets that hold several; written. None without such a bucket."""
        labelled = written(_with_component(self.keys.select("key", "rep", "n"), "rep", "comp", found), "labelled")
        per = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("members"))
        blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
        # buckets with the same members: that of the first band is compared
        mixed = per.where("lo <> hi").groupBy("c", "lo", "hi", "members", "shingles").agg(F.min_by("key", _band("key")).alias("key")).select("key", blocks.alias("blocks"))
        mixed = written(mixed, "mixed")
        if mixed.isEmpty():
            return None
        member = join_spread(labelled, mixed, "key", self.hot, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        group = ("key", "g1", "g2")
        member = member.join(self.texts.groupBy("rep").agg(F.first("sig").alias("sig")), "rep")
        pairs = member.withColumn("other", other).select("key", F.least("block", "other").alias("g1"), F.greatest("block", "other").alias("g2"), "block", "rep", "n", "comp", "sig")
        schema = "key long, g1 int, g2 int, block int, rep long, n long, comp long, sig binary"
        near = written(pairs.repartition(*group).sortWithinPartitions(*group, "rep").mapInPandas(partial(_of_groups, work=partial(_near, percent=self.percent)), schema), "near")
        full = near.join(self.texts.select("rep", "text"), "rep").select(*group, "block", "rep", "n", "comp", "sig", "text")
        groups = full.repartition(*group).sortWithinPartitions(*group, "rep")
        out = written(groups.mapInPandas(partial(_of_groups, work=partial(_links_across, percent=self.percent)), "a long, b long"), "links")
        discard(labelled, mixed, near)
        return out


def _of_groups(batches: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """work of each group, for rows sorted by group (key, g1, g2). A group is two blocks at most."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        ids = rows[["key", "g1", "g2"]].to_numpy()
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist()]
        done = [work(rows.iloc[a:b]) for a, b in zip(cuts, cuts[1:])]
        rest = rows.iloc[cuts[-1] :]
        yield from (d for d in done if len(d))
    if rest is not None and len(rest):
        yield work(rest)
    give_back()


def _candidates(rows: pd.DataFrame, sigs: np.ndarray, i: int, comp: np.ndarray, percent: int, steps: Steps) -> np.ndarray:
    """The later rows of a group that row i has to be held against here: other components, similar size, likely signature,
    another block if the group is of two, and no earlier band in common (there the pair meets in that band's bucket)."""
    n, block = rows["n"].to_numpy(), rows["block"].to_numpy()
    alive = (comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))
    if rows["g1"].iat[0] != rows["g2"].iat[0]:
        alive &= block[i + 1 :] != block[i]
    at = i + 1 + np.flatnonzero(alive)
    at = at[_outlive(sigs[i], sigs[at], steps)]
    band = int(rows["key"].iat[0]) & 63
    met = (sigs[at, : band * ROWS] == sigs[i, : band * ROWS]).reshape(len(at), band, ROWS).all(axis=2).any(axis=1)
    return at[~met]


def _near(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of a group that have a pair to confirm."""
    sigs, comp, steps = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, HASHES), rows["comp"].to_numpy(), pruning_steps(percent)
    hit = np.zeros(len(rows), bool)
    for i in range(len(rows) - 1):
        at = _candidates(rows, sigs, i, comp, percent, steps)
        hit[at] = True
        hit[i] |= len(at) > 0
    return rows[hit]


def _links_across(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between components, enough of them to unite what the group's links unite."""
    sigs, comp, steps = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, HASHES), rows["comp"].to_numpy().copy(), pruning_steps(percent)
    rep, text = rows["rep"].to_numpy(), rows["text"].tolist()
    sets: dict[int, set] = {}
    out = []
    for i in range(len(rows) - 1):
        for j in _candidates(rows, sigs, i, comp, percent, steps).tolist():
            if comp[i] != comp[j]:
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingles(text[k])
                if linked(sets[i], sets[j], percent):
                    comp[comp == max(comp[i], comp[j])] = min(comp[i], comp[j])
                    out.append((rep[i], rep[j]))
        sets.pop(i, None)
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _with_component(rows: DataFrame, column: str, name: str, found: DataFrame) -> DataFrame:
    c = found.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return rows.join(c, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")


def near_duplicates(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """doc_id (long), n_shingles, component_id and kept of every row of docs (doc_id, text); percent links."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(docs.mapInArrow(_signed, "doc_id long, n long, h binary, sig binary"), "signatures")
    named = signed.where("doc_id is not null and n > 0")
    classes = written(named.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("c")), "classes")
    hot = hot_keys(classes, "h", "c", named.count())
    # rows that repeat a doc_id with another text: their classes belong together
    reps = written(join_spread(named.select("doc_id", "n", "h"), classes.select("h", "rep"), "h", hot, "doc_id").select("doc_id", "n", "rep"), "reps")
    several = reps.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).where("b <> c")
    edges = reps.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    c = _Candidates(classes.select("rep", "n", "sig"), docs, percent)
    stars = c.stars()
    found = written(components(edges.union(stars)), "components")
    rest = c.rest(found)
    if rest is not None and not rest.isEmpty():
        found = written(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest)), "components")
    discard(c.keys, c.texts, classes, stars)

    out = _with_component(reps, "rep", "component_id", found)
    none = signed.where("doc_id is null or n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = out.select("doc_id", "n", "component_id").unionByName(none)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_first(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows that repeat it are one document and stay."""
    name = fresh(docs, "_gone")[0]
    gone = written(near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), PERCENT)
