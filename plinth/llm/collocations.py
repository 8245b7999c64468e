"""Collocations by suffix-sigma: one shuffle of truncated suffixes counts the phrases of all lengths.

A text is cut at PIECE_ENDS into pieces and those at space and tab into words (A-Z in lower case). Every word
begins one suffix: it and the words after it in its piece, max_n at most. Suffixes are counted in each slice of SLICE
bytes of text, shuffled by language and first word, sorted in reverse order within their partition (the
language before the words, in one key), so that a longer suffix comes before its prefixes, and swept with one stack: when
a prefix leaves the stack, its count is whole and goes on to the prefix below it. So f of words, pairs and
triples and the number of words of a language come from one pass.

A first word with more than 1 / HOT_PARTS of a sample's suffixes is dealt by its first two words, a pair with as
many by all its words; what the partitions counted of such a hot prefix is summed. The sample (SAMPLE_ROWS texts about)
says only where suffixes go, never what is counted, and hot prefixes number less than
HOT_PARTS for each length, whatever the table.

Parts are joined afterwards: each candidate (a phrase of two words or more with f of min_count or more) meets the
counts of the parts of all its cuts, and hot parts are dealt over tasks. Scores are exact (decimals of 38 digits; f up to 10^16).

Defined results: a null text has no words; a null lang is UNKNOWN; every row counts, repeated ones too; an empty
table gives an empty result. Further columns aren't read. Very long texts and pieces go through in slices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, give_back, hot_keys, join_spread, small_batches, table, written

UNKNOWN = "und"
MAX_WORDS, MIN_COUNT, HELD_PERCENT, TOP = 3, 10, 50, 2000
SLICE, ROWS = 4 << 20, 50_000
SAMPLE_ROWS, HOT_PARTS, HOT_LEAST = 2000, 1000, 200
RANK_PARTS = 64

#: Bytes to bytes: A-Z in lower case, tabs as spaces, PIECE_ENDS as line feeds.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(10 if b in PIECE_ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Between the words of a suffix, below every byte of a word: so a prefix's suffixes are neighbours in order.
SEP = b"\0"
_ODD = re.compile(rb"[\x00\x01]")

SUFFIXES = "key string, n long"
COUNTS = "key string, f long"


def _escaped(text: bytes) -> bytes:
    return _ODD.sub(lambda m: b"\x01\x02" if m[0] == b"\0" else b"\x01\x03", text) if b"\0" in text or b"\x01" in text else text


def _cut(text: bytes, at: int) -> int:
    """Where the slice that begins at `at` ends: behind the last piece, else word, of SLICE bytes, else behind the first word that ends later."""
    for gap in (b"\n", b" "):
        if (found := text.rfind(gap, at, at + SLICE)) >= 0:
            return found + 1
    return min((found + 1 for gap in (b"\n", b" ") if (found := text.find(gap, at + SLICE)) >= 0), default=len(text))


def slices(text: bytes, max_n: int) -> Iterator[tuple[bytes, int]]:
    """A text in slices, and before which byte of each its suffixes begin; behind it are the words that they still need."""
    following = re.compile(rb" *(?:[^ \n]+ *){0,%d}" % (max_n - 1))
    at = 0
    while at < len(text):
        cut = _cut(text, at) if len(text) - at > SLICE else len(text)
        end = cut if text[cut - 1] == 10 else following.match(text, cut).end()
        yield text[at:end], cut - at
        at = cut


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The pieces of data with these starts and lengths, which may overlap, as one array."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    where = np.arange(offsets[-1], dtype=np.int32) + np.repeat((starts - offsets[:-1]).astype(np.int32), lengths)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[where])])


def suffixes(text: bytes, begin: int, max_n: int) -> pa.Array:
    """The truncated suffixes of a slice that begin before this byte; SEP between their words."""
    data = np.frombuffer(text, dtype=np.uint8)
    word = (data != 32) & (data != 10)
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return pa.array([], pa.binary())
    piece = np.cumsum(data == 10, dtype=np.int32)[starts]
    plain = np.append(data, np.uint8(32))
    plain[edges[1::2]] = 0  # each word and one separator
    word = np.append(word, False)
    word[edges[1::2]] = True
    plain, at = plain[word], np.cumsum(lengths + 1) - (lengths + 1)
    ends, more = at + lengths, np.ones(len(starts), dtype=bool)
    for k in range(1, max_n):
        more[-k:] = False
        more[:-k] &= piece[k:] == piece[:-k]
        ends[:-k] = np.where(more[:-k], at[k:] + lengths[k:], ends[:-k])
    own = int(np.searchsorted(starts, begin))
    return gathered(plain, at[:own], (ends - at)[:own])


def _emit(max_n: int):
    """SUFFIXES rows: language and words in key, counted in each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by_lang.setdefault(lang, []).append(text.as_py())
            for lang, texts in by_lang.items():
                head = pa.scalar(_escaped(lang.encode()), pa.binary())
                for some, begin in slices(_escaped(b"\n".join(texts)).translate(_PLAIN), max_n):
                    counted = pa.table({"s": suffixes(some, begin, max_n)}).group_by("s", use_threads=False).aggregate([([], "count_all")])
                    keys = pc.binary_join_element_wise(head, counted["s"], pa.scalar(SEP, pa.binary()))
                    for out in pa.table({"key": keys.cast(pa.string()), "n": counted["count_all"]}).to_batches(ROWS):
                        yield out
        give_back()

    return run


class Sweep:
    """The stack: for each depth the open prefix and its count so far. Keys come in reverse order, a batch at a time.

    Of a batch's prefixes of one depth, equal ones are neighbours; all but the last are whole and leave the stack. What is
    hot goes out with what this partition has of it.
    """

    def __init__(self, max_n: int, least: int, hot: set[bytes]):
        self.deepest, self.least = max_n + 1, least
        self.hot = pa.array(sorted(hot), pa.binary())
        self.open: list[tuple[bytes, int] | None] = [None] * (self.deepest + 1)
        self.keys: list[bytes] = []
        self.found: list[int] = []

    def add(self, keys: pa.Array, times: np.ndarray) -> None:
        keys = keys.cast(pa.binary())
        offsets = np.frombuffer(keys.buffers()[1], dtype=np.int32)[keys.offset : keys.offset + len(keys) + 1]
        data = np.frombuffer(keys.buffers()[2], dtype=np.uint8) if keys.buffers()[2] else np.zeros(0, np.uint8)
        at = np.flatnonzero(data == 0)
        first = np.searchsorted(at, offsets[:-1])
        words = np.searchsorted(at, offsets[1:]) - first + 1
        rows, counts = np.arange(len(keys)), times
        for depth in range(self.deepest, 0, -1):
            deep = words[rows] >= depth
            own = rows[deep]
            if not len(own):
                continue
            more = words[own] > depth
            ends = offsets[own + 1].copy()
            ends[more] = at[first[own[more]] + depth - 1]
            prefixes = gathered(data, offsets[own], ends - offsets[own])
            changed = np.concatenate([[True], pc.not_equal(prefixes[1:], prefixes[:-1]).to_numpy(zero_copy_only=False)])
            begin = np.flatnonzero(changed)
            sums = np.add.reduceat(counts[deep], begin)
            self._close(depth, prefixes, begin, sums)
            kept = ~deep  # shorter keys, and one row for each prefix, in order
            kept[np.flatnonzero(deep)[begin]] = True
            merged = counts.copy()
            merged[np.flatnonzero(deep)[begin]] = sums
            rows, counts = rows[kept], merged[kept]

    def _close(self, depth: int, prefixes: pa.Array, begin: np.ndarray, sums: np.ndarray) -> None:
        held, sums = self.open[depth], sums.copy()
        if held is not None:
            if prefixes[int(begin[0])].as_py() == held[0]:
                sums[0] += held[1]
            else:
                self._out(depth, *held)
        whole = sums[:-1] >= self.least if depth > 1 else np.ones(len(sums) - 1, dtype=bool)
        if 1 < depth < self.deepest and len(self.hot) and len(whole):
            whole = whole | pc.is_in(prefixes.take(pa.array(begin[:-1])), value_set=self.hot).to_numpy(zero_copy_only=False)
        told = np.flatnonzero(whole)
        self.keys += prefixes.take(pa.array(begin[told])).to_pylist()
        self.found += sums[told].tolist()
        self.open[depth] = prefixes[int(begin[-1])].as_py(), int(sums[-1])

    def _out(self, depth: int, prefix: bytes, n: int) -> None:
        if n >= self.least or depth == 1 or depth < self.deepest and pc.is_in(pa.array([prefix]), value_set=self.hot)[0].as_py():
            self.keys.append(prefix)
            self.found.append(n)

    def close(self) -> None:
        for depth in range(self.deepest, 0, -1):
            if held := self.open[depth]:
                self._out(depth, *held)
            self.open[depth] = None

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.keys, pa.binary()).cast(pa.string()), pa.array(self.found, pa.int64())], ["key", "f"])
        self.keys, self.found = [], []
        return out


def _swept(max_n: int, least: int, hot: set[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(max_n, least, hot)
        for batch in batches:
            if batch.num_rows:
                sweep.add(batch.column(0), batch.column(1).to_numpy())
            if len(sweep.keys) >= ROWS:
                yield sweep.take()
        sweep.close()
        yield sweep.take()
        give_back()

    return run


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), col(text).cast("binary").alias("text")).where("text is not null")


def _prefix(words: int) -> Column:
    """The language and the first words of a key; all of it if it has no more."""
    return F.substring_index("key", "\0", words + 1)


def hot_prefixes(texts: DataFrame, rows: int, max_n: int) -> set[bytes]:
    """Language and first words of which a sample of about SAMPLE_ROWS of the rows has more than 1 / HOT_PARTS of its suffixes."""
    some = texts.sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=1).mapInArrow(_emit(max_n), SUFFIXES)
    prefixes = some.select("n", F.explode(F.array_distinct(F.array(*(_prefix(k) for k in range(max_n))))).alias("p"))
    counts = prefixes.groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_LEAST).collect()  # less than max_n / HOT_LEAST of the sample's suffixes
    total = sum(r["n"] for r in counts if "\0" not in r["p"])
    return {r["p"].encode() for r in counts if r["n"] > total // HOT_PARTS and "\0" in r["p"]}


def bucket(hot: set[bytes], max_n: int) -> Column:
    """What a key is dealt by: the shortest of its prefixes (from the first word on) that isn't hot, or all of it."""
    out = F.col("key")
    for words in range(max_n - 1, 0, -1):
        own = [p.decode() for p in hot if p.count(SEP) == words]
        out = F.when(_prefix(words).isin(own), out).otherwise(_prefix(words)) if own else _prefix(words)
    return out


def phrase_counts(docs: DataFrame, max_n: int = MAX_WORDS, min_count: int = MIN_COUNT, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, k (its words), phrase and f of every phrase of 1 to max_n words with f of min_count or more, and for each lang a row with k = 0, an empty phrase and the number of its words."""
    small_batches(docs.sparkSession, ROWS)
    texts = _texts(docs, lang, text)
    hot = hot_prefixes(texts, docs.count(), max_n)
    rows = texts.mapInArrow(_emit(max_n), SUFFIXES).repartition(bucket(hot, max_n)).sortWithinPartitions(F.desc("key"))
    counts = rows.mapInArrow(_swept(max_n, min_count, hot), COUNTS).groupBy("key").agg(F.sum("f").alias("f"))
    words = counts.select(F.split("key", "\\x00", -1).alias("w"), "f")
    plain = words.select(_unescaped(F.col("w")[0]).alias("lang"), (F.size("w") - 1).alias("k"), _unescaped(F.array_join(F.slice("w", 2, max_n), " ")).alias("phrase"), "f")
    return plain.where((F.col("f") >= min_count) | (F.col("k") == 0))


def _unescaped(text: Column) -> Column:
    for a, b in (("\x01\x02", "\0"), ("\x01\x03", "\x01")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _joined(words: str, start: str, length: str) -> str:
    return f"array_join(slice({words}, {start}, {length}), ' ')"


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, k, a, l, r and score (that of the lowest-scoring cut) of the phrases of two words or more."""
    candidates = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.expr("split(phrase, ' ', -1)").alias("w"))
    cut = f"struct(i as cut, array({_joined('w', '1', 'i')}, {_joined('w', 'i + 1', 'k - i')}) as parts)"
    cuts = candidates.select("lang", "phrase", "k", "a", F.explode(F.expr(f"transform(sequence(1, k - 1), i -> {cut})")).alias("c"))
    sides = cuts.select("lang", "phrase", "k", "a", "c.cut", F.posexplode("c.parts").alias("side", "part"))
    key = F.concat("lang", F.lit("\t"), "part").alias("key")  # no word holds a tab
    sides = sides.select("lang", "phrase", "k", "a", "cut", "side", key)
    parts = counts.where("k > 0").select(F.concat("lang", F.lit("\t"), "phrase").alias("key"), "f")
    often = sides.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = sides.count()
    met = join_spread(sides, parts, "key", hot_keys(often, "key", "n", total), "phrase").repartition("lang", "phrase")
    both = met.groupBy("lang", "phrase", "k", "a", "cut").agg(*(F.max(F.when(F.col("side") == i, F.col("f"))).alias(c) for i, c in enumerate("lr")))
    wide = "cast({} as decimal(16, 0))".format
    score = F.expr(f"(1000000 * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def held_inside(counts: DataFrame) -> DataFrame:
    """lang, phrase and most: the largest f of the longer candidates that hold the phrase's words."""
    longer = counts.where("k > 2").select("lang", "f", "k", F.expr("split(phrase, ' ', -1)").alias("w"))
    inner = f"flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> {_joined('w', 'i', 'm')})))"
    return longer.select("lang", "f", F.explode(F.expr(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def _first(rows: DataFrame, keys: list[Column], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def collocations(docs: DataFrame, max_n: int = MAX_WORDS, min_count: int = MIN_COUNT, held_percent: int = HELD_PERCENT, top: int = TOP, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases, without those that a longer candidate holds held_percent of the time or more."""
    counts = written(phrase_counts(docs, max_n, min_count, lang, text), "phrases")
    kept = scored(counts).join(held_inside(counts), ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < held_percent * F.col("a")))
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    ranked = _first(_first(kept, [F.col("lang"), part], top), [F.col("lang")], top)
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents", "lang", "text"))


_GRAMS = " union all ".join(f"select lang, {k} as k, array_to_string(ws[i:i + {k - 1}], ' ') as phrase from (select lang, ws, unnest(range(1, len(ws) - {k} + 2)) as i from w)" for k in range(1, MAX_WORDS + 1))

OP13_SQL = rf"""
with d as (select coalesce(lang, '{UNKNOWN}') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
f as (select lang, k, phrase, count(*)::hugeint as f from ({_GRAMS}) group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= {MIN_COUNT}),
cuts as (select *, array_to_string(ws[1:i], ' ') as h, array_to_string(ws[i + 1:k], ' ') as t from (select *, unnest(range(1, k)) as i from c)),
s as (
  select cuts.lang, cuts.k, cuts.phrase, a, i, l.f as l, r.f as r, 1000000 * a * a // (l.f * r.f) as score
  from cuts join f as l on cuts.lang = l.lang and cuts.h = l.phrase join f as r on cuts.lang = r.lang and cuts.t = r.phrase),
low as (select * from s qualify row_number() over (partition by lang, phrase order by score, i) = 1),
inner_ as (
  select lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase, a from c where k = 3),
most as (select lang, phrase, max(a) as most from inner_ group by all),
kept as (select low.* from low left join most on low.lang = most.lang and low.phrase = most.phrase where most is null or 100 * most < {HELD_PERCENT} * a),
top as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from top join n using (lang) where rank <= {TOP}
"""
