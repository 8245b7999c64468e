import html as escapes
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth.llm import html_extract as h

from .conftest import rows_of

LONG = "The harbour was rebuilt after the flood, and every winter since then its walls have held against the sea and the storms."
MORE = "In the spring the council voted, by a narrow margin, to open the old customs house to visitors; it has since become a museum."


def page(body, head="<title>Site: page</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


NAV = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a><li><a href='/c'>About us</a></ul></nav>"
ARTICLE = f"<h1>The harbour</h1><p>{LONG}</p><p>Yes.</p><p>{MORE}</p>"
TEXT = f"The harbour\n{LONG}\nYes.\n{MORE}"

PAGES = {
    "article": NAV + f"<div class=ad>Buy this fine thing today and save a lot of money.</div><article>{ARTICLE}</article><footer>&copy; 2020 The long name of a publisher, all rights reserved.</footer>",
    "header": f"<header><h1>The Daily</h1><p>{MORE}</p></header><main>{ARTICLE}</main>",
    "title in the article's header": f"<article><header><h1>The harbour</h1></header><p>{LONG}</p><p>Yes.</p><p>{MORE}</p></article>",
    "sidebar": f"<div id=wrap><div class='content has-sidebar'>{ARTICLE}</div><div class=sidebar><h3>More</h3><p>{LONG}</p><p>{MORE}</p></div></div>",
    "aside": f"<article>{ARTICLE}<aside><p>{MORE}</p></aside></article><aside>{LONG}</aside>",
    "notice": f"<div class='cookie-notice'>{LONG}</div><div role=alert>{MORE}</div><article>{ARTICLE}</article>",
    "comments": f"<article>{ARTICLE}</article><section id=comments><h2>Comments</h2>" + f"<article class=comment><p>{LONG} I say.</p></article>" * 5 + "</section>",
    "comments inside": f"<article>{ARTICLE}<div class='comment-list'><p>{LONG}</p><p>{MORE}</p></div></article>",
    "form": f"<article>{ARTICLE}<form action=/s><p>Your address</p><input name=q><button>Send it</button><select><option>One<option>Two</select></form></article>",
    "form around all": f"<form id=aspnet>{NAV}<div class=main>{ARTICLE}</div><div class=footer>{LONG}</div></form>",
    "scripts": f"<article><script>if (a < b) document.write('<p>{LONG}</p>')</script><style>p{{}}</style><noscript><p>{MORE}</p></noscript>{ARTICLE}<template><p>x</p></template></article><iframe>{LONG}</iframe>",
    "divs only": f"<div class=x1><a href=/>Home</a> <a href=/n>News</a></div><div class=x2><h1>The harbour</h1><div class=x3><p>{LONG}</p><p>Yes.</p><p>{MORE}</p></div></div><div class=x4>Imprint</div>",
    "bare paragraphs": f"<ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/m>More</a></ul>{ARTICLE}<div>Imprint</div>",
    "hidden": f"<article>{ARTICLE}<p hidden>{LONG}</p><p style='display: none'>{MORE}</p></article>",
    "long advert, short article": f"{NAV}<div class='ad'>{LONG} {MORE} {LONG} {MORE} {LONG} {MORE}</div><article>{ARTICLE}</article>",
    "teasers with articles": f"<div class='page-with-sidebar'><article>{ARTICLE}</article><div class='related-posts'><article><h2>Other</h2><p>{LONG}</p></article></div></div>",
    "cells": f"<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td>{ARTICLE}</td><td class='ad'>Buy now. {LONG}</td></tr></table>",
    "unclosed": f"<nav><ul><li><a href=/>Home<article><h1>The harbour<p>{LONG}<p>Yes.<p><b>{MORE}<footer>{LONG}",
    "upper case and comments of the markup": f"<!-- <p>{LONG}</p> --><ARTICLE>{ARTICLE}</ARTICLE><![CDATA[ {MORE} ]]>",
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert h.main_text(page(PAGES[name])) == TEXT


def test_tiny_articles():
    """Shorter than everything around them."""
    html = page(f"{NAV}<div class='ad'>{LONG}</div><article><h1>Hi</h1><p>Yes.</p></article><footer>{LONG}</footer>")
    assert h.main_text(html) == "Hi\nYes."
    assert h.main_text(page(f"<div class='ad'>{LONG}</div><h1>Hi</h1><p>Yes.</p>")) == "Hi\nYes."
    assert h.main_text(page(f"<div class='promo'><p>{LONG}</p></div><div class='sidebar'><p>{MORE}</p></div>")) != ""


def test_text_of_blocks():
    body = f"<article><h1>A &lt;b&gt; &amp;\n c&nbsp;d</h1><p>{LONG}<br>Second\tline &#233;&#x20AC;</p><ul><li>one <a href=/>two</a></li><li>three</li></ul><table><tr><td>1</td><td>2</td></tr></table></article>"
    assert h.main_text(page(body)) == f"A <b> & c d\n{LONG} Second line é€\none two\nthree\n1\n2"


def test_head_without_end_and_odd_quotes():
    assert h.main_text(f"<head><title>Not this</title><meta charset=x><article title='a>b'>{ARTICLE}</article>") == TEXT
    assert h.main_text(f"<article><p>{LONG}</p></article><script>var a = 1;") == LONG


def test_smoothing_and_threshold():
    assert h.smoothed([5.0] * 6) == pytest.approx([5.0] * 6)
    assert h.smoothed([0, 0, 9, 0, 0])[2] == max(h.smoothed([0, 0, 9, 0, 0]))
    assert h.deviation([1, 1, 1]) == 0 and h.deviation([0, 2]) == 1


def test_chunks_change_nothing(monkeypatch):
    want = {n: h.main_text(page(b)) for n, b in PAGES.items()}
    monkeypatch.setattr(h, "CHUNK", 7)
    assert {n: h.main_text(page(b)) for n, b in PAGES.items()} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<nav>", "</nav>", "<article>", "</article>", "text ", "&amp", "<", "<!", "<![x", "<?", "</", "<a href='", "<script>", "</script>", "<table><tr><td>", "</table>", "<li>", "\x00", "é"]), max_size=40))
def test_any_markup(parts):
    assert isinstance(h.main_text("".join(parts)), str)


def test_deep_and_long_pages():
    assert h.main_text(page("<div><b>" * 20_000 + f"<p>{LONG}</p>")) == LONG
    assert len(h.main_text(page(f"<article>{ARTICLE * 2000}</article>"))) == 2000 * (len(TEXT) + 1) - 1


def test_table_of_pages(spark, folder):
    rows = [(1, "u", page(PAGES["article"])), (2, "v", None), (3, None, ""), (1, "u", page(PAGES["article"])), (None, "w", "<p></p>"), (4, "x", "just text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = h.op12_html_extract(spark, folder(pages=df))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert rows_of(out) == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, "v", "", 0), (3, None, "", 0), (None, "w", "", 0), (4, "x", "just text", 9)], key=str)
    assert h.extract(df.limit(0)).count() == 0
    clash = df.select("page_id", "html", df.url.alias("a.b`c"), df.url.alias("Text"), df.url.alias("_key"))
    assert h.extract(clash).columns == ["page_id", "a.b`c", "_key", "text", "n_chars"] and h.extract(clash).count() == 6


def test_whole_given_table(spark):
    """Every given page's text is its article, taken out here by patterns."""
    path = "/root/testdata/sf0.01"
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in h.op12_html_extract(spark, path).collect()}
    rows = duckdb.connect().execute(f"select page_id, html from '{path}/pages.parquet'").fetchall()
    for page_id, html in rows:
        article = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>)", html)[1].replace("<br>", " ")
        blocks = [" ".join(escapes.unescape(re.sub(r"<[/a-z][^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[page_id] == (want, len(want))
    assert len(got) == len(rows) == 250
