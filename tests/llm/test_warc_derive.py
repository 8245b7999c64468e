import hashlib
import random
from html import unescape
from html.parser import HTMLParser

from plinth.llm import warc_derive as w

from .conftest import rows_of

HTML = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><script>var a='<p>';</script><h1>Hi &lt;you&gt;</h1><p>one&nbsp; two<br>three &#233;&#128512;&#xyz; <b>bold</b></p></body></html>"


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def test_records(spark):
    df = w.derive(w.responses(pages(spark, (1, "http://a/b", HTML))), keep=("page_id",))
    meta, text = sorted(df.collect(), key=lambda r: r["record_type"], reverse=True)
    assert text["block"] == "Hi <you>\none two\nthree é😀&#xyz; bold"
    assert meta["refers_to"] == text["refers_to"] and text["concurrent_to"] == meta["record_id"]
    assert text["source_payload_digest"] == "sha256:" + hashlib.sha256(HTML.encode()).hexdigest()
    assert text["block_digest"] == "sha256:" + hashlib.sha256(text["block"].encode()).hexdigest() and text["content_length"] == len(text["block"].encode())
    assert "title: A & B\r\n" in meta["block"] and "http-header: Content-Type: text/html; charset=utf-8\r\n" in meta["block"]


class Reader(HTMLParser):
    """The visible text by another way: events of a parser, and its own references."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")
        self.out += ["\n"] * (tag in w.BLOCKS.split("|"))

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")
        self.out += ["\n"] * (tag in w.BLOCKS.split("|"))

    def handle_data(self, data):
        self.out += [data] * (not self.hidden)

    def handle_entityref(self, name):
        self.handle_data(unescape(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(chr(int(name)))


def read(html):
    reader = Reader()
    reader.feed(html)
    reader.close()
    lines = (" ".join(line.replace("\xa0", " ").split()) for line in "".join(reader.out).split("\n"))
    return "\n".join(line for line in lines if line)


def test_text_against_a_parser(spark):
    """Pages of the tables and made ones, with numeric references, against Python's parser."""
    rnd = random.Random(4)
    bits = ["word", " ", "  ", "\t", "\n", "&amp;", "&lt;", "&eacute;"[:0], "&nbsp;", "&#233;", "&#38;", "&#128512;", "<p>", "</p>", "<b>", "</b>", "<br>", "<div class='a'>", "</div>", "<!-- no <p> -->", "<script>x < 1 && '<p>'</script>", "<style>p{}</style>", "&copy;", "&ndash;"]
    made = ["<html><head><title>t</title></head><body>" + "".join(rnd.choice(bits) for _ in range(60)) + "</body></html>" for _ in range(150)]
    real = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    df = pages(spark, *((i, "u", t) for i, t in enumerate(made + real)))
    got = {r["page_id"]: r["block"] for r in w.derive(w.responses(df), keep=("page_id",)).where("record_type = 'conversion'").collect()}
    assert len(real) > 20
    for i, t in enumerate(made + real):
        assert got[i] == read(t), t


ODD = {
    '<p title="a>b">x</p>': "x",
    "<p title = 'a>b>c' class=\"d>e\">x <a href=\"?q='>'\">y</a></p>": "x y",
    "<p>x<script>var a=1;": "x",
    "<style>p{}<p>t": "",
    "<p>x</p><!-- <p>y": "x",
    "<head><title>No</title><meta charset=x><body><p>x": "x",
    "<head><title>No": "",
    "<header>x</header><p>it's 5 > 3, a=\"b\" and 'c'</p>": "x\nit's 5 > 3, a=\"b\" and 'c'",
    "<p data-a=b>x</p><p data-b='c'>y</p>": "x\ny",
}


def test_quotes_and_open_elements(spark, folder, sql):
    df = pages(spark, *((i, "u", t) for i, t in enumerate(ODD)))
    out = w.op1_warc_derivatives(spark, folder(pages=df))
    assert {list(ODD)[r["page_id"]]: r["block"] for r in out.collect() if r["record_type"] == "conversion"} == ODD
    assert rows_of(out) == sql(w.OP1_SQL, out.columns, "pages")


def test_kept_names(spark):
    df = w.responses(pages(spark, (1, "http://a/b", HTML))).withColumnRenamed("page_id", "_Text")
    out = w.derive(df, keep=("_Text", "target_uri", "Block"))
    assert out.columns == ["_Text", *w.RECORD] and {r["_Text"] for r in out.collect()} == {1}


def test_defined_results(spark, folder, sql):
    df = pages(spark, (1, "http://a", None), (2, None, ""), (None, "http://b", "<p>x" * 20000), (3, "http://c", "no tags"), (3, "http://c", "no tags"), (4, "u", "&#65;&#0;&#55296;&#9999999;&#1114112;&#12345678;&#x41;&#X1F600;&#x0;&bogus;&;&amp;lt;&#38;lt; &# &#;&#66"))
    out = w.op1_warc_derivatives(spark, folder(pages=df))
    assert rows_of(out) == sql(w.OP1_SQL, out.columns, "pages") and out.count() == 12
    assert w.derive(w.responses(pages(spark))).count() == 0
    bare = spark.createDataFrame([("<urn:x>", None, None, None, None)], "record_id string, target_uri string, date string, headers string, payload string")
    assert [r["block"].startswith("title: ") for r in w.derive(bare).collect() if r["record_type"] == "metadata"] == [True]


def test_warc_files(spark, tmp_path):
    records = w.derive(w.responses(pages(spark, (1, "http://a/b", HTML))).coalesce(1))
    w.write_warc(records, str(tmp_path / "out"))
    raw = b"".join(f.read_bytes() for f in (tmp_path / "out").glob("part-*"))
    heads = []
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        assert rest[size : size + 4] == b"\r\n\r\n"
        heads.append(fields)
        raw = rest[size + 4 :]
    assert [h["WARC-Type"] for h in heads] == ["metadata", "conversion"] and heads[1]["WARC-Refers-To-Target-URI"] == "http://a/b"
