from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidings.functions import html
from tidings.operators.limits import cap_per_source
from tidings.operators.normalize import article_items
from tidings.sources.page import read_articles

from conftest import rows

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x="<article>no</article>";</script></head><body>
<nav><ul><li><a href="/one">One<li><a href="two">Two</a></ul></nav>
<div class="Story big"><h3 class="title"><a href="https://x.example/1" rel=author>First &amp; best</a></h3>
  <div class="text">Some <b>bold</b>text<br>next<p>para one<p>para two</div><span class="byline"> </span></div>
<div class="story"><h3 class="title"> Second </h3><time>2025-05-22T05:44:39Z</time><span class="byline">Ann</span></div>
<div class="story"><h3>Third</h3><i class="author">&nbsp;</i><u rel="AUTHOR">Bo</u>"""


@pytest.mark.parametrize("selector, texts", [
    ("div.story", 3), ("nav > ul > li", 2), ("nav > li", 0), ("nav li a", 2), ("h3.title a[href], time", 2),
    ("[rel=author]", 2), ("article", 0), ("*.byline", 2), ("#none", 0), ("a[href=two]", 1),
])
def test_selectors(selector, texts):
    assert len(html.select(html.parse(PAGE), selector)) == texts


def test_text():
    root = html.parse(PAGE)
    assert html.text_of(html.select(root, "div.text")) == "Some boldtext next para one para two"
    assert html.text_of(html.select(root, "h3.title")) == "First & best Second"
    assert html.text_of(html.select(root, "script")) == ""
    assert html.text_of(html.select(html.parse("<p>a&nbsp; b​c<!-- no --><style>p{}</style>"), "p")) == "a bc"


def test_unsupported_selector():
    with pytest.raises(ValueError):
        html.select(html.parse(PAGE), "div:nth-child(2)")


def test_unclosed_and_stray_tags():
    root = html.parse("<div><p>a<p>b</span></div></div><p>c</b>")
    assert [p.text() for p in html.select(root, "p")] == ["a", "b", "c"]
    assert [p.text() for p in html.select(root, "div > p")] == ["a", "b"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(
    ["<", ">", "<!", "<![", "<![CDATA[", "]]>", "<!--", "-->", "</", "/>", "<p", "<p>", "</p>", "<div a='", "'", '"', "=", "&", "&#", "&#x1;",
     "&#1114112;", "&amp", ";", "<script>", "</script", "<?", "<!DOCTYPE", "text", " ", "\n", "<li>", "</ul>", "<a href=x>", "</a>", "\x00", "[if"]),
    max_size=25))
def test_any_markup_can_be_read(parts):
    root = html.parse("".join(parts))
    assert isinstance(root.text(), str)
    html.select(root, "p, div > a[href]")


def test_cdata_is_text():
    assert html.parse("<p>a<![CDATA[b < c]]>d<![if x]>e</p>").text() == "ab < cde"


@pytest.fixture(scope="module")
def articles(spark):
    pages = spark.createDataFrame(
        [("Some Site", 0, 0, "https://s.example/p", 2, PAGE), ("Empty", 1, 0, "https://e.example", 5, ""),
         ("Null", 2, 0, "https://n.example", 5, None)],
        "source_name string, source_ord int, page_no int, url string, max_results int, body string",
    ).withColumns({
        "selectors": F.struct(F.lit("div.story").alias("articles"), F.lit("h3").alias("title"),
                              F.lit("div.text").alias("content"), F.lit("time").alias("date")),
        "run_date": F.lit("2025-05-23").cast("date"), "as_of": F.lit("2025-05-23 08:00:00").cast("timestamp"),
    })
    return read_articles(pages)


def test_articles_are_cut_to_the_cap(articles):
    items = article_items(cap_per_source(articles, 5))
    got = rows(items, "id", "title", "url", "author", "publish_zone")
    assert got == [
        ("some-site-0", "First & best", "https://x.example/1", "First & best", "UTC"),
        ("some-site-1", "Second", "https://s.example/p", "Ann", "Z"),
    ]
    dated = items.filter("publish_date is not null").select(F.date_format("publish_date", "HH:mm:ss")).first()[0]
    assert dated == "05:44:39"
