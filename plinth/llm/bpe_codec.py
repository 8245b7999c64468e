"""Byte-level BPE encoding and decoding by tree concatenation.

A text is halved until its leaves have LEAF_CHARS characters at most. The leaves are encoded on
their own, then joined pairwise up the tree: a window of the last tokens of the left side and the
first of the right is encoded again, and grows until its first AGREE tokens are the left side's own
and its last AGREE tokens the right side's own. Tokens beyond such a window are right as they
are: a byte-pair encoding is right if each two neighbours are, and the split into words goes
on alike from a place where two readings agree. Texts of more than PARALLEL_CHARS characters are
spread as pieces over the cluster, encoded there and joined where the document's rows meet.

The vocabulary file is read by the driver and broadcast (its size is fixed by the file). A leaf of
Latin-1 characters is split by a pattern equal to the tokenizer's there and its words are looked
up in a bounded cache of words that the library encoded; any other leaf goes to the library whole.

Defined results: a null text is an empty one, without tokens. Repeated rows give repeated results;
an empty table gives an empty one; further columns named in `keep` pass through (one with the name of a made column
gives way to it). Pieces of a long text meet by a hash of its row, so a stage that runs again gives the same rows. A literal special token in a
text becomes its id, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import col, give_back, small_batches, table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

LEAF_CHARS = 2048
PARALLEL_CHARS = 1 << 16
WINDOW_TOKENS = 16
AGREE = 3
CACHE_WORDS = 200_000

#: The classes of Latin-1 characters in Unicode (letters, numbers, white space).
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


class Codec:
    """A tokenizer file with its tree encoder and its decoder."""

    def __init__(self, source: str):
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        byte = _byte_of_char()
        self.pieces = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = bytes(byte[c] for c in token)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.decimal = list(map(str, range(len(self.pieces))))
        self.known: dict[str, tuple[int, ...]] = {}
        self.ranks = self._by_rank(source)

    def _by_rank(self, source: str) -> tiktoken.Encoding | None:
        """A faster encoder of single words, if ids rank the merges as the file lists them."""
        merges = json.loads(source)["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = self.library.get_vocab(with_added_tokens=False)
        if any(ids.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or len(ids.keys() - self.special) != 256 + len(pairs):
            return None
        ranks = {self.pieces[i]: i for i in range(256 + len(pairs))}
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def _words(self, words: list[str]) -> list[list[int]]:
        if self.ranks is not None:
            return list(map(self.ranks.encode_ordinary, words))
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def leaf(self, text: str) -> list[int]:
        """The ids of a short text, encoded on its own."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.library.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        words = WORDS.findall(text)
        if new := list(set(words).difference(self.known)):
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
                new = list(set(words))
            self.known.update(zip(new, map(tuple, self._words(new))))
        return list(chain.from_iterable(map(self.known.__getitem__, words)))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two texts put together, from the ids of each."""
        k = WINDOW_TOKENS
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            while i and self.pieces[left[i]][0] & 0xC0 == 0x80:
                i -= 1
            while j < len(right) and self.pieces[right[j]][0] & 0xC0 == 0x80:
                j += 1
            raw = b"".join(map(self.pieces.__getitem__, chain(left[i:], right[:j])))
            window = self.leaf(raw.decode())
            whole = not i and j == len(right)
            if whole or len(window) >= 2 * AGREE and (not i or window[:AGREE] == left[i : i + AGREE]) and (j == len(right) or window[-AGREE:] == right[j - AGREE : j]):
                return left[:i] + window + right[j:]
            k *= 2

    def joined(self, parts: list[list[int]]) -> list[int]:
        """The parts joined pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join(*parts[n : n + 2]) if n + 1 < len(parts) else parts[n] for n in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        n = len(text)
        leaves = 1
        while n > leaves * LEAF_CHARS:
            leaves *= 2
        return self.joined([self.leaf(text[n * i // leaves : n * (i + 1) // leaves]) for i in range(leaves)])

    def forget(self) -> None:
        """Drop the known words: workers outlive their tasks."""
        self.known.clear()
        give_back()

    def decode(self, ids: list[int]) -> str:
        """What the library's decode(ids, skip_special_tokens=False) gives."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(source: str) -> Codec:
    return Codec(source)


def _shipped(spark: SparkSession, file: str | None) -> Broadcast:
    with open(file or default_file(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


Finish = Callable[[Codec, list[int]], tuple]
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _made(kept: list, rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """A batch of the kept columns and of rows' columns."""
    made = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([*kept, *map(pa.array, map(list, made), types)], names)


def token_rows(docs: DataFrame, finish: Finish, schema: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", file: str | None = None) -> DataFrame:
    """The kept columns of every row, with what finish makes of its ids (columns of schema, which replace kept ones of their names)."""
    spark = docs.sparkSession
    small_batches(spark)
    source = _shipped(spark, file)
    names, types = zip(*(c.strip().rsplit(" ", 1) for c in schema.split(",")))
    keep = [c for c in keep if c.lower() not in (n.lower() for n in names)]
    own, k = [f"k{i}" for i in range(len(keep))], len(keep)  # whatever the names of the kept columns
    kept = "".join(f"{o} {docs.schema[c].dataType.simpleString()}, " for o, c in zip(own, keep))
    out, arrow = [*own, *names], [_ARROW[t] for t in types]
    body, key, no, at, ids, parts, times = "_text", "_key", "_no", "_at", "_ids", "_parts", "_times"
    rows = docs.select(*(col(c).alias(o) for o, c in zip(own, keep)), F.coalesce(col(text).cast("string"), F.lit("")).alias(body))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for batch in batches:
            yield _made(batch.columns[:k], [finish(c, c.encode(t)) for t in batch.column(k).to_pylist()], out, arrow)
        c.forget()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(source.value)
        for batch in batches:
            yield _made(batch.columns[:-1], [(c.encode(t),) for t in batch.column(k + 3).to_pylist()], [key, *own, no, times, ids], [pa.list_(pa.int32())])
        c.forget()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal rows are one group, which tells how many they are."""
        c = codec(source.value)
        for batch in batches:
            which, made = [], []
            for row, (found, many) in enumerate(zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())):
                which += [row] * many
                made += [finish(c, c.joined([p[ids] for p in found]))] * many
            yield _made([column.take(pa.array(which, pa.int64())) for column in batch.columns[:k]], made, out, arrow)
        c.forget()

    one = rows.where(F.length(body) <= PARALLEL_CHARS).mapInArrow(short, f"{kept}{schema}")
    named = F.sha2(F.concat(F.to_json(F.struct(F.lit(0), *own)), F.col(body)), 256)
    starts = F.sequence(F.lit(1), F.length(body), F.lit(PARALLEL_CHARS))
    cut = rows.where(F.length(body) > PARALLEL_CHARS).select(named.alias(key), *own, F.posexplode(starts).alias(no, at), body)
    cut = cut.select(key, *own, no, F.substr(body, F.col(at), F.lit(PARALLEL_CHARS)).alias(body))
    first = [F.first(c).alias(c) for c in own]
    each = cut.groupBy(key, no).agg(*first, F.count(F.lit(1)).alias(times), F.first(body).alias(body))  # a piece of equal rows once, however many they are
    done = each.select(key, *own, no, times, body).mapInArrow(pieces, f"{key} string, {kept}{no} int, {times} long, {ids} array<int>")
    whole = done.groupBy(key).agg(*first, F.array_sort(F.collect_list(F.struct(no, ids))).alias(parts), F.first(times).alias(times))
    return one.unionByName(whole.select(*own, parts, times).mapInArrow(meet, f"{kept}{schema}")).toDF(*keep, *names)


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", file: str | None = None) -> DataFrame:
    """The kept columns and ids array<int> of every row."""
    return token_rows(docs, lambda c, ids: (ids,), "ids array<int>", keep, text, file)


def decode(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", file: str | None = None) -> DataFrame:
    """The kept columns and the text of every row's ids (null: empty)."""
    small_batches(rows.sparkSession)
    source = _shipped(rows.sparkSession, file)

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        c = codec(source.value)
        return pa.array([c.decode(x or []) for x in column.to_pylist()], pa.string())

    rest = [c for c in keep if c.lower() != "text"]
    return rows.select(*rest, text(F.col(ids)).alias("text"))


def _digests(c: Codec, ids: list[int]) -> tuple[int, str, str]:
    listed = ",".join(map(c.decimal.__getitem__, ids))
    return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()


def digests(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 of every row."""
    return token_rows(docs, _digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"))
