import hashlib
import random

import corpus_pipeline as c
from plinth.llm import bpe_codec, decontaminate, line_dedup, minhash_near_dedup, quality_rules

from .test_decontaminate import brute as leaks
from .test_minhash_near_dedup import brute as groups


def plain(rows, items):
    """The stages once more, without Spark: rows of (doc_id, source, text)."""
    kept = [(d, s, j[-1]) for d, s, t in rows if (j := quality_rules.judge(t))[-2]]
    total, lines = {}, {}
    for d, s, t in kept:
        total[s] = total.get(s, 0) + 1
        for line in set(t.split("\n")):
            if line.split():
                lines[s, line] = lines.get((s, line), 0) + 1
    bad = {k for k, n in lines.items() if n >= line_dedup.MIN_PAGES and n > total[k[0]] * line_dedup.MAX_RATIO}
    kept = [(d, "\n".join(x for x in t.split("\n") if (s, x) not in bad)) for d, s, t in kept]
    roots = groups(kept)
    kept = [(d, t) for d, t in kept if roots[d] == d]
    gone = {d for d, _ in leaks(kept, items)}
    codec = bpe_codec.Codec(open(bpe_codec.default_file(), encoding="utf-8").read())
    return {d: (len(ids := codec.encode(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in kept if d not in gone}


def test_run_against_a_plain_version(spark, docs, folder):
    rnd = random.Random(11)
    vocab = [f"word{i}" for i in range(500)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n)) + "."
    items = [(i, say(30)) for i in range(5)]
    rows = []
    for i in range(80):
        text = "\n".join([*(say(rnd.randint(5, 40)) for _ in range(4)), *(["All rights are held by the site."] if i % 3 == 0 else []), *(["Home | About | News | Contact"] if i % 4 == 0 else [])])
        rows.append((i, f"s{i % 3}", text))
    rows += [(100 + i, "s0", rows[i][2].replace(rows[i][2].split()[7], "changed", 1)) for i in range(6)]
    rows += [(200 + i, "s1", say(60) + "\n" + items[i][1]) for i in range(5)] + [(300, "s2", None), (301, None, say(50)), (302, "s2", ""), (303, "s1", "x " * 60)]
    table = docs(*((d, t, s) for d, s, t in rows))
    path = folder(documents=table, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in c.run(spark, path).collect()}
    want = plain(rows, items)
    assert got == want and 60 < len(want) < len(rows)


def test_stages_keep_the_columns(spark, docs, folder):
    text = "A plain sentence that has more than ten words in it, quite surely."
    table = docs((1, text), (2, text), (3, None))
    path = folder(documents=table, benchmark=spark.createDataFrame([(1, "no such words are here at all")], "item_id long, text string"))
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, table, path)
        assert out.dtypes == table.dtypes
        assert stage(spark, docs(), path).count() == 0


def test_near_copies_between_80_and_85_percent_go(spark, docs):
    words = [f"w{i}" for i in range(104)]
    near, far = (" ".join(w if i not in at else "changed" for i, w in enumerate(words)) for at in ((10, 50), (10, 50, 90)))
    sets = [minhash_near_dedup.shingles(t) for t in (" ".join(words), near, far)]
    likeness = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    assert 0.81 < likeness[0] < 0.83 and likeness[1] < 0.8
    table = docs((1, " ".join(words)), (2, near), (3, "another text " + far[::-1]))
    assert sorted(r["doc_id"] for r in c.near_dedup(spark, table, "").collect()) == [1, 3]
    apart = docs((1, " ".join(words)), (2, far))
    assert c.near_dedup(spark, apart, "").count() == 2


def test_the_query_keeps_its_own_threshold(spark, docs, folder):
    words = [f"w{i}" for i in range(104)]
    rows = [(k, " ".join(w if i not in at else "changed" for i, w in enumerate(words))) for k, at in ((1, ()), (2, (10, 50)), (3, (10,)))]
    path = folder(documents=docs(*rows[:2], (4, rows[1][1])))
    assert {r["doc_id"]: r["component_id"] for r in minhash_near_dedup.op10_minhash_near_dedup(spark, path).collect()} == {1: 1, 2: 2, 4: 2}
    path = folder(documents=docs(*rows))
    assert {r["component_id"] for r in minhash_near_dedup.op10_minhash_near_dedup(spark, path).collect()} == {1}


def test_stages_with_clashing_columns_and_repeated_rows(spark, docs, folder):
    """Extra columns named like the operators' own helpers, nulls, repeated rows and a long text pass every stage."""
    say = lambda k: " ".join(f"w{(k * 37 + i * i) % 900}" for i in range(60)) + "."
    long = "\n".join(say(1000 + i) for i in range(400))
    table = docs(*((i, say(i), f"s{i % 2}") for i in range(12)), (3, say(3), "s1"), (3, say(3), "s1"), (50, long), (60, None, None), (61, ""), (None, say(70)))
    names = ("_site", "_drop", "_Part", "_parts", "_all", "_kept", "_gone", "_doc", "_th", "clean_text", "Kept", "n_lines", "n_dropped", "_text", "_key", "a.b", "c`d")
    table = table.withColumns({n: c.F.concat(c.F.lit(n), c.F.coalesce(c.F.col("doc_id").cast("string"), c.F.lit("-"))) for n in names})
    path = folder(documents=table, benchmark=spark.createDataFrame([(1, say(5))], "item_id long, text string"))
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, table, path)
        assert out.dtypes == table.dtypes, name
        rows = out.collect()
        assert all(r[n] == n + str("-" if r["doc_id"] is None else r["doc_id"]) for r in rows for n in names), name
        ids = [r["doc_id"] for r in rows]
        assert ids.count(3) == 3 and ids.count(50) == 1 and ids.count(None) == 1, name
        assert (5 in ids) == (name != "benchmark decontamination")
    assert c.run(spark, path).where("doc_id = 3").count() == 3
