from plinth.llm import line_dedup as d

from .conftest import rows_of


def table(docs):
    rows = [(i, f"shared footer line\nown line {i}\n\nrare" + ("\nrare two" if i < 3 else ""), "hot") for i in range(60)]
    rows += [(100 + i, f"shared footer line\nother {i}", "small") for i in range(4)]
    return docs(*rows, (200, None, "hot"), (201, "", "hot"), (202, "shared footer line", "hot"), (203, "shared footer line", None), (0, rows[0][1], "hot"))


def test_drops_by_site(spark, docs):
    got = {r["doc_id"]: r["text"] for r in d.drop_boilerplate(table(docs)).collect()}
    assert got[5] == "own line 5\n" and got[1] == "own line 1\n\nrare two"
    assert got[100] == "shared footer line\nother 0" and got[202] == "" and got[203] == "shared footer line"
    assert got[200] is None and got[201] == ""


def test_both_joins_agree(spark, docs, monkeypatch):
    one = rows_of(d.drop_boilerplate(table(docs)))
    monkeypatch.setattr(d, "BROADCAST_BYTES", -1)
    assert rows_of(d.drop_boilerplate(table(docs))) == one
    monkeypatch.setattr("plinth.llm.common.HOT_LEAST", 3)  # the hot site is dealt over tasks
    assert rows_of(d.drop_boilerplate(table(docs))) == one


def test_against_sql(spark, docs, folder, sql):
    out = d.op5_line_dedup(spark, folder(documents=table(docs).where("doc_id <> 0")))
    assert rows_of(out) == sql(d.OP5_SQL, out.columns, "documents")


def test_empty_and_clashing(spark, docs, monkeypatch):
    assert d.drop_boilerplate(docs()).count() == 0
    clash = docs((1, "a")).withColumnRenamed("lang", "n_lines").withColumnRenamed("n_chars", "line")
    for size in (d.BROADCAST_BYTES, -1):
        monkeypatch.setattr(d, "BROADCAST_BYTES", size)
        names = table(docs).withColumnsRenamed({"lang": "_Kept", "n_chars": "a.b", "doc_id": "_site"})
        out = d.drop_boilerplate(names)
        assert out.columns == ["_site", "text", "_Kept", "source", "a.b", "n_lines", "n_dropped"]
        assert {(r["_Kept"], r["_site"]) for r in out.collect()} == {("en", r[0]) for r in table(docs).collect()}
    assert set(d.drop_boilerplate(clash).columns) == {"doc_id", "text", "source", "n_lines", "n_dropped", "line"}
