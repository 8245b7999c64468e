import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import suffix_dedup as s


def brute(rows):
    """By the rule: rows sorted by doc_id; every 100-byte string seen before covers its bytes."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw, gone = (text or "").encode(), set()
        for i in range(len(raw) - s.MIN_BYTES + 1):
            w = raw[i : i + s.MIN_BYTES]
            if w in seen:
                gone.update(range(i, i + s.MIN_BYTES))
            seen.add(w)
        kept = bytes(c for i, c in enumerate(raw) if i not in gone)
        runs = sum(1 for i in gone if i - 1 not in gone)
        out[doc] = (len(raw), len(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    vocab = ["the", "of", "été", "über", "日本", "and", "x"] + [f"w{i}" for i in range(200)]
    say = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    shared = [say(rnd.randint(15, 60)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [say(rnd.randint(0, 40)) for _ in range(rnd.randint(0, 3))] + [rnd.choice(shared) for _ in range(rnd.randint(0, 3))]
        if rows and rnd.random() < 0.2:
            old = rnd.choice(rows)[1]
            parts.append(old[rnd.randint(0, 50) :])
        rnd.shuffle(parts)
        rows.append((i, rnd.choice(["\n", " "]).join(parts)))
    return rows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=50), st.sampled_from([3, 5, 100]))
def test_longest_previous_factors(values, limit):
    want = []
    for i in range(len(values)):
        best = 0
        for j in range(i):
            k = 0
            while i + k < len(values) and values[i + k] == values[j + k] and k < limit:
                k += 1
            best = max(best, k)
        want.append(best)
    assert s.longest_previous_factor(np.array(values), limit).tolist() == want


def test_rolling_hash():
    raw = np.frombuffer(random.Random(1).randbytes(400) * 2, np.uint8)
    for width in (1, 32, 100, 37):
        h = s.rolling(raw, width)
        kinds = {bytes(raw[i : i + width]): int(x) for i, x in enumerate(h)}
        assert len(h) == len(raw) - width + 1 and all(kinds[bytes(raw[i : i + width])] == x for i, x in enumerate(h.tolist())) and len(set(kinds.values())) == len(kinds)


def results(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("seed, cap, hot", [(1, 500, 8), (2, 1, 8), (3, 500, 1), (4, 2, 2)])
def test_against_brute_force(spark, docs, folder, monkeypatch, seed, cap, hot):
    monkeypatch.setattr(s, "BUCKET_ROWS", cap)
    monkeypatch.setattr(s, "UNIT_BYTES", 5000)
    rows = corpus(seed) + [(900, "ab" * 400), (901, "z" * 500), (902, "q" * 99), (903, None), (904, ""), (905, "z" * 100)]
    if hot < 8:
        monkeypatch.setattr(s, "HOT_ROWS", hot)
        monkeypatch.setattr(s, "HOT_SHARE", 0.0)
    path = folder(documents=docs(*rows))
    assert results(s.op9_suffix_dedup(spark, path)) == brute(rows)


def test_a_line_of_every_document(spark, docs, folder):
    line = " ".join(f"line{i}" for i in range(25))
    rnd = random.Random(7)
    rows = [(i, f"{rnd.random()} {rnd.random()}\n{line}\n{rnd.random()} {rnd.random()} {rnd.random()}") for i in range(150)]
    assert results(s.op9_suffix_dedup(spark, folder(documents=docs(*rows)))) == brute(rows)


def test_hot_anchors_are_bounded_and_found(spark, docs, monkeypatch):
    """Those of a line on very many pages, whose ends have other bytes around; with them the result is the same."""
    monkeypatch.setattr(s, "HOT_ROWS", 100)
    monkeypatch.setattr(s, "UNIT_BYTES", 20_000)
    line = " ".join(f"line{i}" for i in range(25))
    rnd = random.Random(9)
    rows = [(i, f"{rnd.random()} {rnd.random()}\n{line}\n{rnd.random()} {rnd.random()} {rnd.random()}") for i in range(600)]
    rows += [(700, rows[3][1]), (701, "no line that others have " * 9), (702, None)]
    df = docs(*rows, rows[5])
    plain = df.selectExpr("doc_id as doc", "0L as th", "text").where("octet_length(text) >= 100")
    hot = s._hot(plain)
    assert 0 < len(hot) <= 2 / s.HOT_SHARE
    held = s.snippets(rows[0][1].encode(), hot)[3]
    assert (held == 1).sum() > 50 and len(s.snippets(rows[601][1].encode(), hot)[0]) < 20
    out = s.with_ranges(df, "doc_id", "text", "body", "ranges")
    digest = s.F.pandas_udf(s._digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")("body", "ranges")
    assert results(out.select("doc_id", digest.alias("d")).select("doc_id", "d.*")) == brute(rows)
    monkeypatch.setattr(s, "HOT_ROWS", 10**9)
    monkeypatch.setattr(s, "BUCKET_ROWS", 40)
    assert not len(s._hot(plain))
    out = s.with_ranges(df, "doc_id", "text", "body", "ranges")
    assert results(out.select("doc_id", digest.alias("d")).select("doc_id", "d.*")) == brute(rows)


def test_equal_hashes_remove_nothing(spark, docs, folder, monkeypatch):
    """With hashes that hardly tell strings apart the bytes still decide."""
    weak = s.rolling
    monkeypatch.setattr(s, "rolling", lambda raw, width: weak(raw, width) & s.np.uint64(0x3C00000) if width == s.MIN_BYTES else weak(raw, width))
    rows = corpus(5, 25)
    unit = [(d, 0, t.encode()) for d, t in rows]
    of, a, p, n, like = s._unit_rows(unit, None)
    assert (like != np.arange(len(like))).sum() > 0
    strings = [(1, d, 0, 0, t.encode()) for d, t in rows if t]
    batch = s._batch(strings, s.STRINGS)
    found = {}
    for out in s._bucket_copies(iter([batch])):
        for r in out.to_pylist():
            found.setdefault(r["doc"], set()).update(range(r["a"], r["b"]))
    assert {d: len(found.get(d, ())) for d, t in rows} == {d: v[1] for d, v in brute(rows).items()}


def test_chunks(monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 256)
    raw = random.Random(3).randbytes(2000)
    _, _, p, n = s.snippets(raw)
    starts = sorted(x for a, k in zip(p.tolist(), n.tolist()) for x in range(a, a + k))
    assert starts == list(range(2000 - s.MIN_BYTES + 1))


def test_null_and_repeated_ids(spark, docs):
    a, b = "a1 " * 10 + "".join(chr(97 + i % 23) + str(i) for i in range(120)), "".join(chr(98 + i % 19) + str(i * 7) for i in range(120))
    df = docs((5, a), (5, a), (6, a), (None, b), (7, b), (8, a + b), (8, b)).withColumnsRenamed({"lang": "_Doc", "source": "a.b", "n_chars": "_ranges"})
    got = sorted(((r["doc_id"], r["text"][:2], len(r["kept_bytes"])) for r in s.deduplicate(df).collect()), key=str)
    assert got.count((5, a[:2], len(a))) == 2 and (6, a[:2], 0) in got and (None, b[:2], len(b)) in got and (7, b[:2], 0) in got and (8, b[:2], 0) in got
    assert s.deduplicate(df).columns == ["doc_id", "text", "_Doc", "a.b", "_ranges", "kept_bytes"] and {r["_Doc"] for r in s.deduplicate(df).collect()} == {"en"}
    assert s.deduplicate(docs()).count() == 0
