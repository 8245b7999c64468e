import random

import pytest

from plinth.llm import minhash_near_dedup as m
from plinth.llm.components import components


def brute(rows):
    sets, parent = {}, {}
    for doc, text in rows:
        parent[doc] = doc
        sets.setdefault(doc, []).append(m.shingles(text))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = [(doc, s) for doc in sets for s in sets[doc]]
    for i, (a, s) in enumerate(docs):
        for b, t in docs[:i]:
            if m.linked(s, t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {doc: root(doc) for doc in parent}


def corpus(seed, groups=8):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, doc = [], 0
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(20, 150))]
        for _ in range(rnd.randint(1, 14)):
            words = list(base)
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            base = words if rnd.random() < 0.4 else base
            rows.append((doc, " ".join(words)))
            doc += 1
    rnd.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, docs, seed):
    rows = corpus(seed)
    n = len(rows)
    rows += [(n, "a b"), (n + 1, "A\tB"), (n + 2, "a b c"), (n + 3, ""), (n + 4, None), (n + 5, ""), (n + 6, "k " * 30000), (n + 7, rows[0][1])]
    got = {r["doc_id"]: r for r in m.near_duplicates(docs(*rows)).collect()}
    want = brute(rows)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == d) and r["n_shingles"] == len(m.shingles(dict(rows)[d])) for d, r in got.items())


def test_a_large_group_of_near_copies(spark, docs):
    rnd = random.Random(9)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rnd.randrange(120)] = f"x{rnd.randrange(50)}"
        words[rnd.randrange(120)] = f"y{rnd.randrange(50)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in m.near_duplicates(docs(*rows)).collect()}
    assert got == brute(rows)


def test_null_and_repeated_ids(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = m.near_duplicates(docs((5, a), (5, b), (7, a), (9, b), (None, a), (5, a))).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(5, 5, True), (7, 5, False), (9, 5, False), (None, None, True)} and len(got) == 6
    left = m.keep_first(docs((5, a), (7, a), (9, "z")).withColumnRenamed("lang", "kept"))
    assert sorted(r["doc_id"] for r in left.collect()) == [5, 9] and "kept" in left.columns
    assert m.near_duplicates(docs()).count() == 0


def test_every_text_of_a_repeated_id_links(spark, docs):
    a, b = [f"a{i}" for i in range(80)], [f"b{i}" for i in range(80)]
    rows = [(8, "in the middle of three"), (9, "in the middle of three"), (9, " ".join(a)), (9, "one more text of nine"), (1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "x"])), (3, " ".join([*b[:-1], "y"])), (4, "alone here")]
    assert {r["doc_id"]: r["component_id"] for r in m.near_duplicates(docs(*rows)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 8: 1, 9: 1}


def test_signatures_estimate_similarity():
    a, b = (m.hashed_set(" ".join(f"w{i}" for i in range(k, k + 400))) for k in (0, 40))
    s = m.signatures([a, b])
    exact = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((s[0] == s[1]).mean() - exact) < 0.12
    assert m.least_matches(m.HASHES) < 0.85 * m.HASHES and m.least_matches(40) > 10


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [tuple(rnd.sample(range(200, 300), 2)) for _ in range(60)] + [(1, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for x in parent}


def test_recall_against_exact_links_of_a_whole_table(spark):
    """Every pair of sf0.01's documents that share a shingle, by an index of shingles: all links are found and no other."""
    folder = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], m.shingles(r["text"])) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    of, parent, links = {}, {d: d for d, _ in rows}, 0
    sets = dict(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in rows:
        shared = {}
        for g in s:
            for e in of.get(g, ()):
                shared[e] = shared.get(e, 0) + 1
            of.setdefault(g, []).append(d)
        for e, n in shared.items():
            if 100 * n >= m.PERCENT * (len(s) + len(sets[e]) - n):
                links += 1
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    got = {r["doc_id"]: r["component_id"] for r in m.op10_minhash_near_dedup(spark, folder).collect()}
    assert links > 50 and got == {d: root(d) for d in parent}


def test_equal_sets_of_different_texts_are_one_class(spark, docs):
    """A cycle of words said twice or three times has one set of shingles; numbers of shingles are those of the full sets."""
    cycle = " ".join(f"c{i}" for i in range(9))
    df = docs((4, f"{cycle} {cycle}"), (2, f"{cycle} {cycle} {cycle}"), (3, cycle), (9, "A b"), (8, "a  B\n"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in m.near_duplicates(df).collect()}
    assert got == {4: (9, 2), 2: (9, 2), 3: (5, 3), 9: (1, 8), 8: (1, 8)}
    assert all(got[r["doc_id"]][0] == len(m.shingles(r["text"])) for r in df.collect())
