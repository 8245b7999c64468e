"""Exact substring dedup by longest-previous-factor arrays.

Every byte that a MIN_BYTES-byte string covers which also starts earlier (in a document of a smaller doc_id,
or earlier in the same document) is removed; the first occurrence stays. Matches never cross documents.

A suffix array of the whole corpus isn't needed, as only strings of MIN_BYTES bytes decide. Hashes route strings to
where they meet; what is removed has been compared byte by byte or by suffix order.

1. Each window of MIN_BYTES bytes has an anchor, the least of the hashed GRAM-byte strings in it. Equal
   windows have equal anchors at equal places. Neighbouring windows with one anchor form a snippet, and a row
   says where it stands. Documents are worked on in units of UNIT_BYTES; snippets that are equal, byte by byte, to an
   earlier one of their unit are copies at once, so a snippet of very many documents gives a row a unit.
2. Rows meet by anchor. Anchors with one row have no copy; for the others the snippets' bytes are cut out of the texts
   (one join) and meet by anchor again: a bucket.
3. In a bucket, in the order of appearance, equal strings take one place (the later ones are copies). The different
   strings get a suffix array (ranks doubled up to MIN_BYTES), the previous and next smaller position of each suffix in
   suffix order, and from the two common prefixes the longest previous factor; windows with a factor of MIN_BYTES or more
   are copies. Windows whose hash the bucket holds once can't be and stay out of the arrays.
4. A bucket of very many different snippets (the ends of a line that very many pages share, with other bytes around)
   would be one task's work. So the windows of hot anchors are snippets of their own, which meet by the window's
   hash. Hot are anchors that some unit's rows hold with a share of HOT_SHARE and that have half of that share of all
   rows: every anchor with 1.5 times HOT_SHARE of all rows is found, and they number 2 / HOT_SHARE at most, whatever
   the corpus, so the list is broadcast. Other buckets of more than BUCKET_ROWS rows are cut into windows after step 2,
   and their windows meet the same way, in the same arrays.

Each document's copied runs are then put together and cut out.

Defined results: a null text is an empty one. A null doc_id comes before all others. Rows that repeat a
doc_id are ordered by a hash of their text; equal rows are one document and give equal results. An empty table
gives an empty one. `deduplicate` keeps further columns, whatever their names (kept_bytes is replaced).

The operator runs its jobs while the plan is built and deletes the tables that nothing reads afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, discard, fresh, give_back, small_batches, table, written

MIN_BYTES = 100
GRAM = 32
UNIT_BYTES = 8 << 20
BUCKET_ROWS = 50_000
HOT_ROWS, HOT_SHARE = 2000, 1e-4
FLUSH_BYTES = 1 << 18
CHUNK = 1 << 20

_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P2
    return h ^ (h >> np.uint64(29))


def rolling(raw: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the width bytes from each place on, by doubling."""
    if len(raw) < width:
        return np.zeros(0, np.uint64)
    h, size, out, done, factor = raw.astype(np.uint64) + np.uint64(1), 1, None, 0, _P1
    while True:
        if width & size:  # the bytes from done on
            part = h[done : done + len(raw) - width + 1]
            out = part.copy() if out is None else out * factor + part
        done += size if width & size else 0
        if done == width:
            return _mixed(out)
        h = h[: len(h) - size] * factor + h[size:]
        size *= 2
        factor = np.uint64(int(factor) ** 2 & (1 << 64) - 1)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor hash and place of each window of MIN_BYTES bytes."""
    h = rolling(raw, GRAM)
    low = np.uint64((1 << 22) - 1)  # room for the place within a chunk
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    best = _sliding_min(key, MIN_BYTES - GRAM + 1)
    at = (best & low).astype(np.int64)
    return h[at], at


Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def snippets(raw: bytes, hot: np.ndarray | None = None) -> Rows:
    """Of each run of windows with one anchor, in order: anchor hash, snippet hash, first window, number of windows.

    Windows with a hot anchor are runs of their own, with the window's hash for an anchor.
    """
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for start in range(0, max(0, len(raw) - MIN_BYTES + 1), CHUNK):
        part = np.frombuffer(raw, np.uint8, min(CHUNK + MIN_BYTES - 1, len(raw) - start), start)
        hashes, at = anchors(part)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        count = np.diff(np.r_[first, len(at)])
        windows = rolling(part, MIN_BYTES)
        # a snippet is shorter than two windows: its first and last window, its length and its anchor's place tell it
        shape = (count * 128 + at[first] - first).astype(np.uint64)
        own = _mixed(windows[first] * _P3 ^ _mixed(windows[first + count - 1] + shape * _P1))
        rows = hashes[first], own, first + start, count
        if hot is not None and len(hot) and (burnt := np.isin(rows[0], hot)).any():
            alone = np.flatnonzero(np.repeat(burnt, count))
            cut = windows[alone], windows[alone], alone + start, np.ones(len(alone), np.int64)
            rows = tuple(np.concatenate((x[~burnt], y)) for x, y in zip(rows, cut))
            order = np.argsort(rows[2], kind="stable")
            rows = tuple(x[order] for x in rows)
        out.append(rows)
    return tuple(map(np.concatenate, zip(*out)))


Unit = list[tuple[int, int, bytes]]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[Unit]:
    """Different documents (doc, th, bytes) in their order, in units of about UNIT_BYTES."""
    rows, size = {}, 0
    for batch in batches:
        for doc, th, text in zip(*(c.to_pylist() for c in batch.columns)):
            rows[doc, th] = raw = text.encode()
            size += len(raw)
            if size >= UNIT_BYTES:
                yield [(*k, raw) for k, raw in sorted(rows.items())]
                rows, size = {}, 0
    if rows:
        yield [(*k, raw) for k, raw in sorted(rows.items())]


def _unit_rows(unit: Unit, hot: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Of a unit's snippets, in order: document (place in the unit), anchor, first window, number of windows, and the place of
    an earlier snippet of the same hashes (or its own)."""
    parts = [snippets(raw, hot) for *_, raw in unit]
    of = np.repeat(np.arange(len(unit)), [len(p[0]) for p in parts])
    a, s, p, n = map(np.concatenate, zip(*parts))
    key = _mixed(a * _P1 ^ s)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
    like = np.empty(len(order), np.int64)
    like[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else 0
    return of, a, p, n, like


def _hot_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with HOT_SHARE of a unit's rows and their number there; with a null anchor, the number of all rows."""
    for unit in _units(batches):
        _, a, *_, like = _unit_rows(unit, None)
        a = a[like == np.arange(len(a))]
        kinds, counts = np.unique(a, return_counts=True)
        often = counts >= max(2, HOT_SHARE * len(a))
        yield pa.RecordBatch.from_arrays([pa.array([None, *kinds[often].view(np.int64).tolist()], pa.int64()), pa.array([len(a), *counts[often].tolist()], pa.int64())], ["anchor", "n"])
    give_back()


def _hot(docs: DataFrame) -> np.ndarray:
    """The hot anchors, 2 / HOT_SHARE at most."""
    found = docs.mapInArrow(_hot_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = written(found, "anchors")
    total = found.where("anchor is null").agg(F.sum("n")).first()[0] or 0
    rows = found.where(F.col("anchor").isNotNull() & (F.col("n") >= max(HOT_ROWS, HOT_SHARE / 2 * total))).collect()
    discard(found)
    return np.array(sorted(r["anchor"] for r in rows), np.int64).view(np.uint64)


def suffix_order(raw: np.ndarray, limit: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first limit symbols, and their ranks at 1, 2, 4 ... symbols up to limit."""
    rank = np.unique(raw, return_inverse=True)[1].astype(np.int64)
    ranks, size = [rank], 1
    while size < limit:
        step = min(size, limit - size)
        after = np.full(len(rank), -1, np.int64)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        size += step
    return np.argsort(rank, kind="stable"), ranks


def _previous_smaller(values: np.ndarray) -> np.ndarray:
    """The place of the nearest smaller value before each, or -1."""
    out, stack = np.full(len(values), -1, np.int64), []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][0] >= v:
            stack.pop()
        if stack:
            out[i] = stack[-1][1]
        stack.append((v, i))
    return out


def longest_previous_factor(raw: np.ndarray, limit: int = MIN_BYTES) -> np.ndarray:
    """For each place the longest string (limit symbols at most) that starts there and also at an earlier place.

    A suffix's earlier match with the longest common prefix stands, in suffix order, at the nearest smaller
    position on one of its two sides.
    """
    if len(raw) < 2:
        return np.zeros(len(raw), np.int64)
    order, ranks = suffix_order(raw, limit)
    before = _previous_smaller(order)
    after = len(order) - 1 - _previous_smaller(order[::-1])[::-1]
    lpf = np.zeros(len(raw), np.int64)
    for side, exists in ((before, before >= 0), (after, after < len(order))):
        here, there = order[exists].copy(), order[np.clip(side[exists], 0, len(order) - 1)].copy()
        at, length = here.copy(), np.zeros(len(here), np.int64)
        sizes = [1]
        while sizes[-1] < limit:
            sizes.append(min(2 * sizes[-1], limit))
        for rank, size in zip(reversed(ranks), reversed(sizes)):
            inside = (here < len(raw)) & (there < len(raw))
            same = np.zeros(len(here), bool)
            same[inside] = rank[here[inside]] == rank[there[inside]]
            here, there, length = here + size * same, there + size * same, length + size * same
        lpf[at] = np.maximum(lpf[at], np.minimum(length, limit))
    return lpf


def copied_windows(parts: list[bytes]) -> list[np.ndarray]:
    """Of parts in their order of appearance: for each the starts of windows that came earlier."""
    symbols, starts, at = [], [], 0
    for k, part in enumerate(parts):
        starts.append(at)
        symbols += [np.frombuffer(part, np.uint8).astype(np.int64), np.array([256 + k])]  # each part ends in a symbol of its own
        at += len(part) + 1
    lpf = longest_previous_factor(np.concatenate(symbols))
    return [np.flatnonzero(lpf[s : s + len(p)] >= MIN_BYTES) for s, p in zip(starts, parts)]


def copied_ranges_of(parts: list[bytes]) -> list[tuple[int, int, int]]:
    """(part, first window, last window) of the copied runs of parts, which are in their order of appearance.

    A window whose hash occurs once has no earlier match. Of the runs of other windows equal ones after the first are
    copies, and the different ones get the arrays.
    """
    ends = np.cumsum([len(p) for p in parts])
    whole = rolling(np.frombuffer(b"".join(parts), np.uint8), MIN_BYTES)
    at = np.arange(len(whole))
    part = np.searchsorted(ends, at, side="right")
    inside = at + MIN_BYTES <= ends[part]
    at, part = at[inside], part[inside]
    _, kind, count = np.unique(whole[at], return_inverse=True, return_counts=True)
    again = count[kind] > 1
    at, part = at[again], part[again]
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(part) > 0))
    first, last = np.r_[0, cut + 1], np.r_[cut, len(at) - 1]
    begins = ends - np.array([len(p) for p in parts])
    out, different = [], {}
    for k, a, b in zip(part[first].tolist(), (at[first] - begins[part[first]]).tolist(), (at[last] - begins[part[last]]).tolist()):
        raw = parts[k][a : b + MIN_BYTES]
        if raw in different:
            out.append((k, a, b))
        else:
            different[raw] = (k, a)
    for (k, a), found in zip(different.values(), copied_windows(list(different))):
        if len(found):
            out += [(k, a + int(x), a + int(y)) for x, y in zip(*_runs(found))]
    return out


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of numbers in a row."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]]


COPIES = "doc long, th long, a int, b int"


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _bucket_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings (anchor, doc, th, p, raw) sorted by anchor, doc, th, p: the copied ranges of each anchor's bucket.

    A string that equals an earlier one of its bucket is a copy and kept no longer. The different ones of whole buckets share one
    suffix array; equal windows have one anchor, so none is found across buckets.
    """
    waiting: list[tuple] = []  # the different strings of buckets before, with their places
    bucket: dict[bytes, tuple] = {}
    size, anchor, last = 0, None, None

    def flush() -> list[tuple]:
        found = copied_ranges_of([raw for raw, _ in waiting]) if waiting else ()
        return [(doc, th, p + a, p + b + MIN_BYTES) for k, a, b in found for doc, th, p in (waiting[k][1],)]

    for batch in batches:
        out = []
        for key, doc, th, p, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if key != anchor:
                if len(bucket) > 1:
                    waiting += bucket.items()
                    size += sum(map(len, bucket))
                    if size >= FLUSH_BYTES:
                        out += flush()
                        waiting, size = [], 0
                anchor, last, bucket = key, None, {}
            place = doc, th, p
            if place == last:  # a repeated row: the same document
                continue
            last = place
            if raw in bucket:
                out.append((doc, th, p, p + len(raw)))
            else:
                bucket[raw] = place
        yield _batch(out, COPIES)
    if len(bucket) > 1:
        waiting += bucket.items()
    yield _batch(flush(), COPIES)
    give_back()


STRINGS = "anchor long, doc long, th long, p int, raw binary"


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of documents (doc, th, text, members)."""
    for batch in batches:
        rows = []
        for doc, th, text, members in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            rows += [(m["anchor"], doc, th, m["p"], raw[m["p"] : m["p"] + m["n"] + MIN_BYTES - 1]) for m in members]
            if len(rows) > 100_000:
                yield _batch(rows, STRINGS)
                rows = []
        yield _batch(rows, STRINGS)
    give_back()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of strings, routed by their hash; of equal ones of a batch the first, and the others as copies (raw null)."""
    for batch in batches:
        seen, rows = {}, []
        for _, doc, th, p, raw in sorted(zip(*(c.to_pylist() for c in batch.columns)), key=lambda r: r[1:4]):
            hashes = rolling(np.frombuffer(raw, np.uint8), MIN_BYTES).view(np.int64).tolist()
            for i, h in enumerate(hashes):
                window = raw[i : i + MIN_BYTES]
                if (place := seen.setdefault(window, (doc, th, p + i))) == (doc, th, p + i):
                    rows.append((h, doc, th, p + i, window))
                else:
                    rows.append((h, doc, th, p + i, None))
        yield _batch(rows, STRINGS)
    give_back()


def _copies_of(strings: DataFrame) -> DataFrame:
    return strings.repartition("anchor").sortWithinPartitions("anchor", "doc", "th", "p").mapInArrow(_bucket_copies, COPIES)


def copied_ranges(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """doc, th, a, b of every copied byte range (ranges may overlap), and the written tables that it reads.

    docs: doc long, th long, text string.
    """
    spark = docs.sparkSession
    small_batches(spark)
    hot = spark.sparkContext.broadcast(_hot(docs))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n is the number of windows; copies within the unit, as whole ranges, have its length with a minus and go anywhere."""
        for unit in _units(batches):
            of, a, p, n, like = _unit_rows(unit, hot.value)
            copy = np.zeros(len(of), bool)
            later = np.flatnonzero(like != np.arange(len(of)))
            for i, j, d, e, x, y, m in zip(later.tolist(), *(c.tolist() for c in (like[later], of[later], of[like[later]], p[later], p[like[later]], n[later] + MIN_BYTES - 1))):
                copy[i] = n[j] == n[i] and unit[d][2][x : x + m] == unit[e][2][y : y + m]
            of1, a1 = of[copy], p[copy]
            b1 = a1 + n[copy] + MIN_BYTES - 1
            new = np.flatnonzero(np.r_[True, (of1[1:] != of1[:-1]) | (a1[1:] > b1[:-1])]) if len(of1) else np.zeros(0, np.int64)
            end = np.r_[new[1:], len(of1)] - 1 if len(of1) else new
            keys = np.array([(doc, th) for doc, th, _ in unit], np.int64).reshape(-1, 2)
            who = np.concatenate((of[~copy], of1[new]))
            start = np.concatenate((p[~copy], a1[new]))
            spread = _mixed(keys[of1[new], 0].view(np.uint64) * _P1 + a1[new].astype(np.uint64))
            anchor = np.concatenate((a[~copy], spread)).view(np.int64)
            size = np.concatenate((n[~copy], a1[new] - b1[end]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[who, 0]), pa.array(keys[who, 1]), pa.array(anchor), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["doc", "th", "anchor", "p", "n"])
        give_back()

    mates = F.count(F.lit(1)).over(Window.partitionBy("anchor"))
    rows = docs.mapInArrow(rows_of, "doc long, th long, anchor long, p int, n int").withColumn("k", mates)
    marked = written(rows.where("n < 0 or k > 1"), "marked")
    copies = marked.where("n < 0").select("doc", "th", F.col("p").alias("a"), (F.col("p") - F.col("n")).alias("b"))

    def strings(members: DataFrame) -> DataFrame:
        lists = members.groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "p", "n")).alias("members"))
        return docs.join(lists, ["doc", "th"]).select("doc", "th", "text", "members").mapInArrow(_sliced, STRINGS)

    members = marked.where("n > 0")
    copies = copies.unionByName(_copies_of(strings(members.where(F.col("k") <= BUCKET_ROWS))))
    large, used = members.where(F.col("k") > BUCKET_ROWS), [marked]
    if not large.isEmpty():
        windows = written(strings(large).mapInArrow(_windows, STRINGS), "windows")
        copies = copies.unionByName(windows.where("raw is null").select("doc", "th", F.col("p").alias("a"), (F.col("p") + MIN_BYTES).alias("b")))
        copies = copies.unionByName(_copies_of(windows.where("raw is not null")))
        used.append(windows)
    return copies, used


def _merged(ranges: list) -> tuple[list[int], list[int]]:
    """Sorted (a, b) ranges as maximal runs."""
    starts, ends = [], []
    for a, b in ranges:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _cut(raw: bytes, ranges) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go and in how many runs."""
    if ranges is None or not len(ranges):
        return raw, 0, 0
    starts, ends = _merged(sorted((int(r["a"]), int(r["b"])) for r in ranges))
    kept = b"".join(raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)]))
    return kept, len(raw) - len(kept), len(starts)


def with_ranges(docs: DataFrame, doc_id: str, text: str, body: str, ranges: str) -> DataFrame:
    """docs with two columns more: body, the text (null: empty), and ranges, the copied byte ranges of each row (null: none)."""
    doc, th, many = fresh(docs, "_doc", "_th", "_many")
    keyed = docs.withColumns({doc: F.coalesce(col(doc_id).cast("long"), F.lit(-(1 << 63))), body: F.coalesce(col(text).cast("string"), F.lit(""))})
    repeated = keyed.groupBy(doc).agg(F.count(F.lit(1)).alias(many)).where(F.col(many) > 1).select(doc, F.lit(True).alias(many))
    if repeated.isEmpty():
        keyed = keyed.withColumn(th, F.lit(0).cast("long"))
    else:
        keyed = keyed.join(written(repeated, "repeated"), doc, "left").withColumn(th, F.when(F.col(many), F.xxhash64(body)).otherwise(0)).drop(many)
    plain = keyed.select(F.col(doc).alias("doc"), F.col(th).alias("th"), F.col(body).alias("text")).where(F.octet_length("text") >= MIN_BYTES)
    found, used = copied_ranges(plain)
    lists = found.groupBy(F.col("doc").alias(doc), F.col("th").alias(th)).agg(F.collect_list(F.struct("a", "b")).alias(ranges))
    lists = written(lists, "ranges")
    discard(*used)
    return keyed.join(lists, [doc, th], "left").drop(doc, th)


def _digest(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    out = []
    for text, r in zip(texts, ranges):
        raw = text.encode()
        kept, gone, runs = _cut(raw, r)
        out.append((len(raw), gone, runs, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept(texts: pd.Series, ranges: pd.Series) -> pd.Series:
    return pd.Series([_cut(t.encode(), r)[0] for t, r in zip(texts, ranges)])


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with kept_bytes, what is left of each text (a cut may fall within a character)."""
    body, ranges = fresh(docs, "_body", "_ranges")
    out = with_ranges(docs.select(*[col(c) for c in docs.columns if c.lower() != "kept_bytes"]), doc_id, text, body, ranges)
    return out.withColumn("kept_bytes", F.pandas_udf(_kept, "binary")(body, ranges)).drop(body, ranges)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_ranges(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", "body", "ranges")
    digest = F.pandas_udf(_digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")("body", "ranges")
    return out.select("doc_id", digest.alias("d")).select("doc_id", "d.*")
