from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import quality_rules as q

from .conftest import rows_of

GOOD = "This is a plain sentence with enough words to be kept by every rule here. Another one follows, which says no word twice over."


def plain_repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(words):
    assert q.repeated_words([w.encode() for w in words]) == plain_repeats(words)


def test_words_split_at_ascii_space_only():
    n, chars, *_ = q.judge("a b\x1cc\x85 d\x0be\n\r\f")
    assert (n, chars) == (3, 8)


def test_line_rules():
    fails = lambda line: q.line_fails(line.encode(), len(line.split()))
    assert fails("Home | About | News | Contact") and fails("a%%% b### c&&& d") and fails("WOW!! NO!! YES!!") and fails("Read our Privacy Policy.")
    assert fails("one two three four five six seven eight nine ten eleven twelve")
    assert not fails("一 二 三 四 五 六 七 八 九 十 百 千。") and not fails("क ख ग घ च छ ज झ ट ठ ड ढ।") and not fails("a b c d e f g h i j k l؟")
    assert not fails("A short heading") and not fails("One sentence, that ends well.")


def test_line_first_then_document(spark, docs):
    nav = "Home | About | News | Contact | Help | Jobs | Press | Terms"
    df = docs((1, GOOD + "\n" + nav), (2, "\n".join([nav + f" | x{i}" for i in range(9)]) + "\nfine words here."), (3, "too short."), (4, None), (5, ""), (1, GOOD + "\n" + nav))
    got = {r["doc_id"]: (r["kept"], r["clean_text"]) for r in q.clean(df).collect()}
    assert got[1] == (True, GOOD) and not got[2][0] and not got[3][0] and got[4] == (False, None) and got[5] == (False, "")
    assert q.measure(df).count() == 6


def test_defined_results(spark, docs, folder, sql):
    long = ("word%d goes on. " * 3000) % tuple(range(3000))
    df = docs((1, GOOD), (2, "a b c d e\na b c d e\n\n a b c d e"), (3, None), (4, ""), (5, "x " * 50), (6, long), (7, " \n\t "), (8, "é|»• ! … <b>"), (9, "क ख ग घ च छ ज झ ट ठ ड ढ।\nक ख ग घ च छ ज झ ट ठ ड ढ"))
    path = folder(documents=df)
    out = q.op7_quality_rules(spark, path)
    assert rows_of(out) == sql(q.OP7_SQL, out.columns, "documents")
    assert q.measure(docs()).count() == 0
    clash = df.withColumnRenamed("lang", "kept").withColumnRenamed("source", "clean_text")
    assert q.clean(clash).columns.count("kept") == 1
    dotted = q.clean(df.withColumnRenamed("lang", "a.b"))
    assert dotted.columns == ["doc_id", "text", "a.b", "source", "n_chars", "clean_text", "kept"] and dotted.count() == df.count()
    assert "ArrowEval" not in (plan := q.clean(df).where("kept")._jdf.queryExecution().executedPlan().toString()) and plan.count("MapInArrow") == 1
