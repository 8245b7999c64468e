import random

from plinth.llm import common
from plinth.llm import url_filters as u

from .conftest import rows_of

URLS = ["https://a.Example.NET/en/1?x", "http://net/", "http://net", "https://x.org/fr/", "https://x.org/de", "http://www.example.com/de/9#t", "http://badexample.com/de/", None, "", "nonsense", "http://", "http://u@H.net:80/x", "mailto:a@b.net/", "http://é.net/ü"]


def pages(spark, urls):
    return spark.createDataFrame([(i, x, "<p>") for i, x in enumerate(urls)], "page_id long, url string, html string")


def test_against_sql(spark, folder, sql):
    out = u.op8_url_filters(spark, folder(pages=pages(spark, URLS + [None])))
    assert rows_of(out) == sql(u.OP8_SQL, out.columns, "pages")
    assert out.count() == len(URLS) + 1


def test_every_block_size_gives_the_same_rows(spark, folder, sql, monkeypatch):
    """Repeated pages, null ids and repeated urls under other ids; blocks of one rule too."""
    rows = [(i, x, "<p>") for i, x in enumerate(URLS)] * 3 + [(None, URLS[0], "<p>"), (None, URLS[0], "<p>"), (None, None, "<p>"), (99, URLS[0], "<p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = folder(pages=df)
    want = sql(u.OP8_SQL, ["page_id", "host", "path", "rule", "verdict"], "pages")
    rules = spark.createDataFrame([*u.RULES, u.RULES[0], (None, "net", "/"), ("block", None, "/"), ("allow", "net", None)], "verdict string, host string, path string")
    for size in (100, 2, 1):
        out = u.filter_urls(spark.read.parquet(f"{path}/pages.parquet").select("page_id", "url"), rules, block_rules=size).drop("url")
        assert rows_of(out) == want and len(want) == len(rows)
    monkeypatch.setattr(u, "BLOCK_BYTES", 20)
    assert rows_of(u.filter_urls(df.select("page_id", "url"), rules).drop("url")) == want


def test_verdicts(spark):
    rules = spark.createDataFrame(u.RULES, "verdict string, host string, path string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in u.filter_urls(pages(spark, URLS), rules).collect()}
    assert got[URLS[0]] == ("example.net/en/", "allow") and got[URLS[1]] == ("net/", "block") and got[URLS[2]] == (None, "allow")
    assert got[URLS[5]] == ("example.com/de/", "block") and got[URLS[6]] == (None, "allow") and got[None] == (None, "allow")


def best(rules, host, path):
    fits = [(len(h + p), h.count(".") if h else -1, h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: (f[0], len(f[2].split("/")[0])))[2:] if fits else (None, "allow")


def test_random_rules_and_blocks(spark):
    rnd = random.Random(3)
    name = lambda: ".".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4)))
    way = lambda: rnd.choice(["", "/", "/"]) and "/" + "".join(rnd.choice("xy/") for _ in range(rnd.randint(0, 4)))
    rules = list({(h, p): (rnd.choice(["block", "allow"]), h, p) for h, p in ((name(), way()) for _ in range(60))}.values())
    urls = [(i, name(), way()) for i in range(400)]
    df = spark.createDataFrame(urls, "id long, h string, p string").repartition(3)
    table = spark.createDataFrame([*rules, ("block", None, "/"), ("block", "", "/")], "verdict string, host string, path string")
    want = {i: best(rules, h, p) for i, h, p in urls}
    assert sum(not p for _, _, p in rules) > 3
    for block in (1000, 7, 1):
        got = {r["id"]: (r["rule"], r["verdict"]) for r in u.match_rules(df, table, "h", "p", "rule", "verdict", block).collect()}
        assert got == want


def test_ties_go_to_the_longer_host(spark):
    """Rules of one length, the path of one empty; every block size gives the same."""
    rules = spark.createDataFrame([("block", "b.net", ""), ("allow", "net", "/x"), ("allow", "b.net", "/"), ("block", "net", "")], "verdict string, host string, path string")
    urls = pages(spark, ["http://b.net/x", "http://b.net", "http://c.net/xy", "http://a.b.net/"])
    for block in (100, 3, 1):
        got = {r["url"]: (r["rule"], r["verdict"]) for r in u.filter_urls(urls, rules, block_rules=block).collect()}
        assert got == {"http://b.net/x": ("b.net/", "allow"), "http://b.net": ("b.net", "block"), "http://c.net/xy": ("net/x", "allow"), "http://a.b.net/": ("b.net/", "allow")}
    two = spark.createDataFrame([("block", "b.net", ""), ("allow", "net", "/x")], "verdict string, host string, path string")
    assert [u.filter_urls(urls.limit(1), two, block_rules=n).collect()[0]["rule"] for n in (2, 1)] == ["b.net", "b.net"]


def test_a_pair_with_most_pages(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 5)
    rows = pages(spark, ["http://a.net/x"] * 60 + URLS).repartition(4)
    rules = spark.createDataFrame(u.RULES, "verdict string, host string, path string")
    assert rows_of(u.filter_urls(rows, rules, block_rules=1)) == rows_of(u.filter_urls(rows, rules))


def test_empty(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert u.filter_urls(pages(spark, []), none).count() == 0
    clash = pages(spark, ["http://a.b/c"]).withColumnsRenamed({"page_id": "_Host", "html": "_key"})
    dotted = pages(spark, ["http://a.b/c"]).withColumnsRenamed({"page_id": "page.id", "html": "row"})
    for block in (1, 100):
        out = u.filter_urls(dotted, spark.createDataFrame(u.RULES, "verdict string, host string, path string"), block_rules=block)
        assert out.columns == ["page.id", "url", "row", "host", "path", "rule", "verdict"] and out.count() == 1
    assert u.filter_urls(clash, none).columns == ["_Host", "url", "_key", "host", "path", "rule", "verdict"]
    assert u.filter_urls(clash, spark.createDataFrame(u.RULES, "verdict string, host string, path string"), block_rules=1).collect()[0]["_key"] == "<p>"
    assert [r["verdict"] for r in u.filter_urls(pages(spark, ["http://a.b/c"]).withColumnRenamed("html", "rule"), none).collect()] == ["allow"]
