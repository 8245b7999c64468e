import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plinth.llm import bpe_codec as b

SOURCE = open(b.default_file(), encoding="utf-8").read()
CODEC, LIBRARY = b.Codec(SOURCE), Tokenizer.from_str(SOURCE)
PIECES = ["a", "b", "the", "'s", "'re", "'", "''", " ", "  ", "\n", "\t", "!!", "1", "23", "é", "ö", "日本", "<|endoftext|>", "<|endo", "ing", "Z", "😀", "́", " ", "\u0085", "....", "'ll", "՘"]


def plain(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("code", range(256))
def test_latin_characters_split_alike(code):
    c = chr(code)
    text = f"a{c}1{c}!{c}{c}a {c}'s{c}re  {c}"
    assert CODEC.leaf(text) == plain(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=150), st.integers(5, 60))
def test_tree_is_the_library(pieces, leaf):
    text, kept = "".join(pieces), b.LEAF_CHARS
    b.LEAF_CHARS = leaf
    try:
        ids = CODEC.encode(text)
    finally:
        b.LEAF_CHARS = kept
    assert ids == plain(text)
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert CODEC.encode(text) == plain(text)


def test_long_unsplit_texts():
    for text in ("x" * 30000, "ab" * 9000, "é" * 9000, "!?" * 9000, " " * 9000 + "a", "1234567890" * 900):
        assert CODEC.encode(text) == plain(text)


def test_tables(spark, docs, monkeypatch):
    monkeypatch.setattr(b, "PARALLEL_CHARS", 5000)
    long = "Some words, 123 and more. " * 2000 + "y" * 7000
    df = docs((1, "hello world"), (2, None), (3, ""), (4, long), (4, long), (None, "é" * 6000))
    got = sorted((r.asDict() for r in b.digests(df).collect()), key=lambda r: (r["doc_id"] or 0, r["n_tokens"]))
    texts = ["é" * 6000, "hello world", "", "", long, long]
    assert [r["n_tokens"] for r in got] == [len(plain(t)) for t in texts]
    assert [r["ids_sha256"] for r in got] == [hashlib.sha256(",".join(map(str, plain(t))).encode()).hexdigest() for t in texts]
    assert [r["decoded_sha256"] for r in got] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert sorted(r["text"] for r in b.decode(b.encode(df)).collect()) == sorted(texts)
    assert b.digests(docs()).count() == 0
    assert b.encode(df.withColumnRenamed("lang", "ids"), keep=("doc_id", "source")).columns == ["doc_id", "source", "ids"]
    dotted = b.encode(df.withColumnsRenamed({"lang": "a.b", "source": "_key"}), keep=("doc_id", "a.b", "_key"))
    assert dotted.columns == ["doc_id", "a.b", "_key", "ids"] and {r["a.b"] for r in dotted.collect()} == {"en"}


def test_repeated_long_rows_are_encoded_once(spark, docs, monkeypatch):
    """Pieces of equal rows meet before they are encoded; each row has its result."""
    monkeypatch.setattr(b, "PARALLEL_CHARS", 40)
    text = "many words go on and on, " * 9
    df = docs(*[(1, text)] * 30, (2, text), (1, text + "x"), (3, "short")).repartition(5)
    got = sorted((r["doc_id"], r["ids"]) for r in b.encode(df).collect())
    monkeypatch.undo()
    want = sorted((r["doc_id"], r["ids"]) for r in b.encode(df).collect())
    assert got == want and len(got) == 33
