"""Quality rules, line first: judge each line, remove what fails, then judge the document by its loss.

Words are runs of anything but space and \\x09-\\x0D, counted over the whole text.

A line with a word fails if one of these rules holds:

* navigation: it has NAV_BARS separators (| » › •) or more,
* symbols: symbols of `#*$%&|<>` number more than SYMBOLS_PER_WORD of its words,
* punctuation: PLAIN_WORDS words or more and none of ENDS in it (ends of sentences, of wide, Arabic and
  Indic scripts too), or exclamation marks numbering more than BANGS_PER_WORD of its words,
* boilerplate: one of BOILERPLATE occurs in it (ASCII letters compared in lower case).

Lines without a word have no text to lose and stay. A document is kept if it passes the base
rules (MIN_WORDS words; repeated words at most MAX_REPEAT_PERCENT) and the failing lines hold at
most MAX_LOST_PERCENT of its words.

Defined results: a null text has no words, so it fails the base rule and is not kept; its clean
text is null. Rows are judged one by one, so repeated rows give repeated results, an empty
table gives an empty one, and further columns pass through `clean` untouched (a column that
`clean` adds replaces one of the same name, in whatever case).

Both `measure` and `clean` are one pass of an Arrow function over batches of bounded bytes, in the plan once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import col, give_back, small_batches, table

NAV_BARS = 3
SYMBOLS_PER_WORD = 0.3
BANGS_PER_WORD = 0.5
PLAIN_WORDS = 12
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50
WINDOW = 5

#: Phrases that mark a line as boilerplate.
BOILERPLATE = (
    "lorem ipsum",
    "enable javascript",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "subscribe to our newsletter",
    "click here to",
)
SYMBOLS = b"#*$%&|<>"
_PHRASES = tuple(p.encode() for p in BOILERPLATE)
_BARS = ("|".encode(), "»".encode(), "›".encode(), "•".encode())
#: Characters of which one at least stands in a line of plain text.
ENDS = ".!?:;…。！？：；؟؛۔।"
_ASCII_ENDS = "".join(c for c in ENDS if c.isascii()).encode()
_WIDE_ENDS = tuple(c.encode() for c in ENDS if not c.isascii())

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_failed_lines long, n_lost_words long, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a window of five words that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, until = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + WINDOW - max(at, until)
            until = at + WINDOW
    return covered


def line_fails(line: bytes, n_words: int) -> bool:
    """Whether one of the line rules holds for a line of n_words words, 1 or more."""
    if sum(map(line.count, _BARS)) >= NAV_BARS:
        return True
    if len(line) - len(line.translate(None, SYMBOLS)) > SYMBOLS_PER_WORD * n_words:
        return True
    if n_words >= PLAIN_WORDS and len(line.translate(None, _ASCII_ENDS)) == len(line) and not any(e in line for e in _WIDE_ENDS):
        return True
    if line.count(b"!") > BANGS_PER_WORD * n_words:
        return True
    low = line.lower()
    return any(p in low for p in _PHRASES)


def judge(text: str | None) -> tuple:
    """MEASURES of one text, then its clean text."""
    raw = (text or "").encode()
    words = raw.split()  # of bytes: at space and \x09-\x0D only
    n = len(words)
    word_chars = len(text or "") - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    kept, dup, failed, lost = [], 0, 0, 0
    for line in raw.split(b"\n"):
        m = len(line.split())
        if m:
            dup += line in seen
            seen.add(line)
            if line_fails(line, m):
                failed, lost = failed + 1, lost + m
                continue
        kept.append(line)
    repeat = repeated_words(words)
    base = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    keep = not base and 100 * lost <= MAX_LOST_PERCENT * n
    clean = None if text is None else (b"\n".join(kept).decode() if failed else text)
    return n, word_chars, symbols, dup, repeat, base, failed, lost, keep, clean


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and MEASURES of every row."""
    small_batches(docs.sparkSession)
    plain = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    names, types = zip(*(m.split() for m in MEASURES.split(", ")))
    arrow = [{"long": pa.int64(), "boolean": pa.bool_()}[t] for t in types]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(judge(t)[:-1] for t in batch.column(1).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, arrow)], ["doc_id", *names])
        give_back()

    return plain.mapInArrow(judged, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def clean(docs: DataFrame, text: str = "text", names: tuple[str, str] = ("clean_text", "kept")) -> DataFrame:
    """docs with two columns more, names: clean_text (the text without its failing lines) and kept."""
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() not in (n.lower() for n in names)]
    rows = docs.select(*(col(c).alias(f"c{i}") for i, c in enumerate(rest)), col(text).cast("string").alias("text"))
    fields = [*rows.schema.fields[:-1], StructField("clean_text", StringType()), StructField("kept", BooleanType())]

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [judge(t)[-2:] for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c for _, c in made], pa.string()), pa.array([k for k, _ in made], pa.bool_())], [f.name for f in fields])
        give_back()

    return rows.mapInArrow(cleaned, StructType(fields)).toDF(*rest, *names)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(table(spark, sf_dir, "documents", "doc_id", "text"))


_PHRASE_SQL = " or ".join(f"contains(low, '{p}')" for p in BOILERPLATE)

#: The same rules as SQL; run over the whole table.
OP7_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, t from d),
base as (
  select doc_id, len(ws)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols
  from w),
pos as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
win as (
  select doc_id, i, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o as g
  from pos window o as (partition by doc_id order by i)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win where g is not null) where c > 1),
rep as (select doc_id, count(distinct i + k)::bigint as n_repeat_words from twice, (select unnest(range(5)) as k) group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
ln as (
  select doc_id, line, lower(line) as low,
    len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as m
  from lines),
bad as (
  select doc_id, line, m,
    length(line) - length(regexp_replace(line, '[|»›•]', '', 'g')) >= {NAV_BARS}
    or length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > {SYMBOLS_PER_WORD}::double * m
    or (m >= {PLAIN_WORDS} and not regexp_matches(line, '[{ENDS}]'))
    or length(line) - length(replace(line, '!', '')) > {BANGS_PER_WORD}::double * m
    or {_PHRASE_SQL} as fails
  from ln where m > 0),
per as (
  select doc_id, (count(*) - count(distinct line))::bigint as n_dup_lines,
    (count(*) filter (fails))::bigint as n_failed_lines, coalesce(sum(m) filter (fails), 0)::bigint as n_lost_words
  from bad group by doc_id),
all_ as (
  select doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words,
    n_words < {MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > {MAX_REPEAT_PERCENT} * n_words as base_failed,
    coalesce(n_failed_lines, 0) as n_failed_lines, coalesce(n_lost_words, 0) as n_lost_words
  from base left join per using (doc_id) left join rep using (doc_id))
select *, not base_failed and 100 * n_lost_words <= {MAX_LOST_PERCENT} * n_words as kept from all_
"""
