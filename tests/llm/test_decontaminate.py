import random

import numpy as np

from plinth.llm import decontaminate as d


def table_score(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (d.MATCH if x == y else d.MISMATCH), h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randint(0, 3) for _ in range(rnd.randint(1, 15))] for _ in range(2))
        assert d.local_score(np.array(a), np.array(b)) == table_score(a, b)


def corpus():
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.randint(18, 50))) for i in range(12)]
    docs = [(i, say(200)) for i in range(60)]
    for i, (_, text) in enumerate(items):
        words = text.split()
        edited = [w if rnd.random() > 0.12 else rnd.choice(["zz", ""]) for w in words]
        docs += [(100 + i, f"{say(80)} {text.upper()}! {say(50)}"), (200 + i, f"{say(30)} {' '.join(edited)} {say(90)}"), (300 + i, f"{say(40)} {' '.join(words[:5])} {say(60)}")]
    return docs, items


def brute(docs, items):
    out = {}
    for doc, text in docs:
        for item, it in items:
            a, b = d.words(it), d.words(text)
            number = {w: i for i, w in enumerate({*a, *b})}
            if len(a) >= d.SEED_WORDS and b:
                s = d.local_score(np.array([number[w] for w in a]), np.array([number[w] for w in b])) / (d.MATCH * len(a))
                if s >= d.MIN_SCORE:
                    out[doc, item] = round(s, 6)
    return out


def test_against_brute_force(spark, docs, folder):
    rows, items = corpus()
    extra = [(900, None), (901, ""), (902, ("w1 w2 " * 30000) + items[0][1]), (100, rows[60][1])]
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "w1 w2")], "item_id long, text string")
    path = folder(documents=docs(*rows, *extra), benchmark=bench)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in d.op2_decontaminate(spark, path).collect()}
    assert got == brute([*rows, extra[2]], items)
    assert all(got.get((100 + i, i)) == 1.0 for i in range(12)) and not any(300 <= k[0] < 400 for k in got)
    blocks = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs(*rows, *extra), bench, block_bytes=600).collect()}
    assert blocks == set(got)


def test_common_items_are_found_in_every_document(spark, docs):
    rows, items = corpus()
    hot = [(i, f"x{i} y{i} {items[0][1]} z{i}") for i in range(300)]
    got = d.contaminated(docs(*hot), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == set(range(300))


def test_removal(spark, docs):
    rows, items = corpus()
    df = docs(*rows, (None, rows[0][1]), (None, items[3][1]), (1, rows[1][1]))
    left = d.remove_contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == df.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert ids.count(None) == 1 and ids.count(1) == 2 and not [i for i in ids if i and 100 <= i < 300]
    assert d.remove_contaminated(docs(), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_copies_without_a_run_of_four_words(spark, docs):
    rnd = random.Random(7)
    say = lambda n: " ".join(f"v{rnd.randrange(900)}" for _ in range(n))
    items = [(i, say(40)) for i in range(6)]
    rows = [(i, say(150)) for i in range(10)]
    for i, (_, text) in enumerate(items):
        for k in range(4 if i else 1):  # of item 0 there is one copy; of the others copies that keep different grams
            edited = [w if (j + k) % 4 != 3 else "zz" for j, w in enumerate(text.split())]
            rows.append((100 + 10 * i + k, f"{say(60)} {' '.join(edited)} {say(60)}"))
    # a common gram whose neighbours are there too, and rarer
    w = items[1][1].split()
    rows += [(200 + k, f"{say(20)} {' '.join(w[4:7])} {say(20)}") for k in range(5)]
    got = d.contaminated(docs(*rows), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in got.collect()}
    assert found == brute(rows, items) and {(100 + 10 * i, i) for i in range(6)} <= set(found) and not any(k[0] >= 200 for k in found)


def test_common_grams_need_company(spark, docs, monkeypatch):
    monkeypatch.setattr(d, "COMMON_DOCS", 5)
    rnd = random.Random(3)
    say = lambda n: " ".join(f"v{rnd.randrange(900)}" for _ in range(n))
    phrase = "as a matter of fact"
    items = [(i, f"{say(12)} {phrase} {say(12)}") for i in range(20)] + [(20, "matter of fact too"), (7, say(20)), (7, say(25))]
    rows = [(i, f"{say(30)} {phrase} {say(30)}") for i in range(200)] + [(300 + i, f"{say(20)} {t} {say(20)}") for i, (_, t) in enumerate(items)]
    edited = [w if j % 4 != 3 else "zz" for j, w in enumerate(items[2][1].split())]
    rows += [(400, " ".join(edited))]
    got = d.contaminated(docs(*rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): round(r["score"], 6) for r in got.collect()} == brute(rows, items)
    block = d.Block([(t, [i]) for i, t in items])
    d._counted(docs(*rows), block)
    assert 0 < block.common.sum() < 12


def test_equal_items_and_clashing_names(spark, docs):
    rows, items = corpus()
    bench = spark.createDataFrame([(k, items[0][1]) for k in range(500)] + items[1:], "item_id long, text string")
    got = d.contaminated(docs(rows[60]), bench, block_bytes=2000)
    assert {r["item_id"] for r in got.collect()} == set(range(500))
    clash = docs(rows[0], rows[60]).withColumnsRenamed({"lang": "_Doc", "source": "_th", "n_chars": "_id"})
    left = d.remove_contaminated(clash, bench)
    assert left.columns == clash.columns and [tuple(r) for r in left.collect()] == [tuple(r) for r in clash.collect() if r["doc_id"] == rows[0][0]]
