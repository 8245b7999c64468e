import random
import zlib

from plinth.llm import toxicity as t

BAD, OK = ["vilest", "scummy", "dreadful", "loathing"], [f"w{chr(97 + i)}{chr(97 + j)}ing" for i in range(12) for j in range(12)]


def texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice(OK) for _ in range(rnd.randint(40, 200))]
        toxic = i % 4 == 0
        for _ in range(rnd.randint(3, 8) if toxic else 0):
            words.insert(rnd.randint(0, len(words)), rnd.choice(BAD))
        out.append((" ".join(words), int(toxic)))
    return out


def test_windows_are_the_text():
    raw = t.prepared("A  few\nWords " * 30)
    w = t.windows(raw)
    assert b" ".join(x.strip() for x in w) == raw.strip() and t.windows(b"") == []


def test_held_out_accuracy():
    of = t.fit(texts(400, 1)).scorer()
    new = texts(200, 2)
    right = sum((of(x) >= 0.5) == bool(y) for x, y in new)
    assert right >= 190
    assert all(0 <= of(x) <= 1 for x in (None, "", "x", "y " * 9999))


def test_too_few_labels():
    assert t.fit([]).scorer()("x") == 0.0
    assert t.fit([("a b", 1), ("c d", 0)]).scorer()("x") == 0.5


def test_query(spark, docs, folder):
    rows = [(i, x) for i, (x, _) in enumerate(texts(300, 3))]
    labels = [(i, y) for i, (_, y) in enumerate(texts(300, 3))] + [(5, None), (None, 1), (7, 0), (999, 1)]
    df = docs(*rows, (1000, None), (1001, ""), (0, rows[0][1]))
    path = folder(documents=df, labels=spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id long, quality int, toxic int"))
    got = t.op3_toxicity(spark, path).collect()
    assert len(got) == 303 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {i: y for i, (_, y) in enumerate(texts(300, 3))}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert len({r["score"] for r in got if r["doc_id"] in (1000, 1001)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 0}) == 1


def test_labels_of_held_out_rows_do_not_count(spark, docs):
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    df = docs(*[(i, f"text {i}") for i in range(200)])
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, toxic int")
    rows, share = t.training_rows(df, labels)
    assert len(rows) == 200 - len(out) and share == 1.0 and not {x for x, _ in rows} & {f"text {i}" for i in out}


def test_long_texts_take_no_places_of_the_sample(spark, docs, monkeypatch):
    monkeypatch.setattr(t, "MAX_TRAIN_CHARS", 50)
    df = docs(*[(i, "long " * 40 if i % 3 else f"text {i}") for i in range(300)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    rows, _ = t.training_rows(df, labels, max_rows=20)
    assert len(rows) == 40 and all(len(x) <= 50 for x, _ in rows)


def test_scores_against_a_plain_recomputation(spark, docs):
    """The features once more, window by window, with compressors made here."""
    import math

    import zstandard

    rows = texts(300, 5)
    model = t.fit(rows)
    new = texts(40, 6) + [("", 0), ("one", 0)]
    got = {r["doc_id"]: r["score"] for r in t.score(docs(*((i, x) for i, (x, _) in enumerate(new))), model).collect()}

    def size(window, raw):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=t.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    for i, (text, _) in enumerate(new):
        won = sorted((size(w, model.ordinary) - size(w, model.ordinary + model.toxic) for w in t.windows(t.prepared(text))), reverse=True)
        hits = len([x for x in won if x >= t.HIT])
        x = [min(won[0], 12) / 5, min(sum(won[:3]) / 3, 12) / 5, math.log(1 + hits), min(20 * hits / len(won), 3), sum(won) / len(won)] if won else [0] * 5
        assert abs(got[i] - 1 / (1 + math.exp(-(model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x)))))) < 1e-9
