import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import collocations as c

from .conftest import rows_of

SCHEMA = "lang string, text string"


def plain_pieces(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for end in ".,;:!?\n\x0b\x0c\r":
        low = low.replace(end, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in low.split("\n")]


def plain_counts(rows, max_n):
    f = defaultdict(Counter)
    for lang, text in rows:
        for words in plain_pieces(text):
            for k in range(1, max_n + 1):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f


def plain(rows, max_n=3, least=10, percent=50, top=2000):
    out = []
    for lang, f in plain_counts(rows, max_n).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not inside:
                score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out, key=str)


def some_rows(seed, texts=60):
    rnd = random.Random(seed)
    words = ["the"] * 6 + ["of", "The", "sea", "é", "\x01x", "x\x00", "\x02", "new", "york", "city", "\xa0", "A\x1cB"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "."]) for _ in range(rnd.randint(0, 60)))
    return [(rnd.choice(["en", "en", "de", None, ""]), text()) for _ in range(texts)]


def words_of(suffix):
    return tuple(w.replace(b"\x01\x02", b"\0").replace(b"\x01\x03", b"\x01").decode() for w in suffix.split(c.SEP))


def found(text, max_n):
    return Counter(words_of(s) for some, begin in c.slices(c._escaped(text.encode()).translate(c._PLAIN), max_n) for s in c.suffixes(some, begin, max_n).to_pylist())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aB .\t\n\x00\x01é", max_size=60), st.integers(1, 5), st.sampled_from([1, 2, 3, 5, 8, 1000]))
def test_suffixes_of_a_text(text, max_n, size):
    kept, c.SLICE = c.SLICE, size
    try:
        assert found(text, max_n) == Counter(tuple(w[i : i + max_n]) for w in plain_pieces(text) for i in range(len(w)))
    finally:
        c.SLICE = kept


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "aa", "é"]), min_size=1, max_size=3), max_size=40), st.integers(1, 7))
def test_sweep_in_batches(suffixes, size):
    """The stack over batches of any size: all prefixes' counts."""
    keys = sorted(("\0".join(["en" if len(s) % 2 else "de", *s]).encode() for s in suffixes), reverse=True)
    sweep, want = c.Sweep(3, 2, {b"en\0a"}), Counter()
    for k in keys:
        w = k.split(c.SEP)
        want.update(c.SEP.join(w[:i]) for i in range(1, len(w) + 1))
    for at in range(0, len(keys), size):
        sweep.add(pa.array([k.decode() for k in keys[at : at + size]], pa.string()), np.full(len(keys[at : at + size]), 1))
    sweep.close()
    assert len(set(sweep.keys)) == len(sweep.keys)
    assert dict(zip(sweep.keys, sweep.found)) == {k: n for k, n in want.items() if n >= 2 or c.SEP not in k or k == b"en\0a"}


def test_against_sql_and_plain(spark, folder, sql):
    rows = some_rows(1) * 2
    path = folder(documents=spark.createDataFrame([r for r in rows if "\x00" not in (r[1] or "")] + [("en", None)], SCHEMA))
    out = c.op13_phrase_collocations(spark, path)
    assert rows_of(out) == sql(c.OP13_SQL, out.columns, "documents") == plain([r for r in rows if "\x00" not in r[1]])


@pytest.mark.parametrize("max_n,least,percent", [(3, 4, 50), (4, 3, 70), (2, 10, 50), (5, 2, 100)])
def test_against_plain(spark, max_n, least, percent):
    rows = some_rows(max_n)
    assert rows_of(c.collocations(spark.createDataFrame(rows, SCHEMA), max_n, least, percent, 40)) == plain(rows, max_n, least, percent, 40)


def test_hot_prefixes_change_nothing(spark, monkeypatch):
    """Every frequent prefix hot, and small buffers: partial counts are summed to the same."""
    rows = some_rows(9, 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = plain(rows, least=5)
    monkeypatch.setattr(c, "HOT_LEAST", 1)
    monkeypatch.setattr(c, "SLICE", 50)
    hot = c.hot_prefixes(c._texts(df, "lang", "text"), df.count(), 3)
    assert {b"en\0the", b"en\0the\0of", b"en\0x\x01\x02"} < hot
    assert rows_of(c.collocations(df, min_count=5)) == want
    keys = [("en\0the\0of\0sea",), ("en\0the\0city\0é",), ("en\0rare\0of",), ("en\0the",)]
    assert [r[0] for r in spark.createDataFrame(keys, "key string").select(c.bucket({b"en\0the", b"en\0the\0of"}, 3)).collect()] == [keys[0][0], "en\0the\0city", "en\0rare", "en\0the"]


def test_hot_sample_doesnt_decide_counts(spark, monkeypatch):
    rows = some_rows(4, 100)
    monkeypatch.setattr(c, "SAMPLE_ROWS", 1)
    assert rows_of(c.collocations(spark.createDataFrame(rows, SCHEMA), min_count=5)) == plain(rows, least=5)


def test_exact_scores_beyond_64_bits(spark):
    a = 3_000_000_000_000
    rows = [("en", 1, "x", a + 1), ("en", 1, "y", a + 2), ("en", 2, "x y", a)]
    counts = spark.createDataFrame(rows, "lang string, k int, phrase string, f long")
    assert [tuple(r) for r in c.scored(counts).collect()] == [("en", "x y", 2, a, a + 1, a + 2, 1000000 * a * a // ((a + 1) * (a + 2)))]


def test_defined_results(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.collocations(empty).count() == 0
    assert c.collocations(spark.createDataFrame([("en", None), (None, ""), ("en", " .,\n")], SCHEMA)).count() == 0
    got = rows_of(c.collocations(spark.createDataFrame([(None, "New York")] * 10 + [("und", "new york!")] * 2, SCHEMA)))
    assert got == [("und", 1, "new york", 12, 12, 12, 24, 1000000)]
    odd = spark.createDataFrame([("en", "a b", 1, 2)] * 10, "`l.ang` string, text string, suffix int, n int")
    assert c.collocations(odd, lang="l.ang").count() == 1
    long = spark.createDataFrame([("en", "ha " * 300_000)], SCHEMA)
    assert rows_of(c.collocations(long)) == plain([("en", "ha " * 300_000)])
