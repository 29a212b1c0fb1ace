"""Web pages: articles by selector and the columns derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.catalog import query
from tidings.functions.text import article_id
from tidings.functions.urls import article_url
from tidings.operators.limits import cap_per_source
from tidings.operators.normalize import article_items
from tidings.plans import adapters as A
from tidings.sources.page import first_author, read_articles

ARTICLE = {"articles": "article", "title": "h1", "content": "p", "date": "time"}
LINKS = {"articles": "nav > ul > li", "title": "a", "content": "a[href]"}

# A heading may be cut right before the semicolon.
UNESCAPE = "regexp_replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;?', '&', 'g')"
SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def text_sql(expr: str) -> str:
    tagless = f"regexp_replace({expr}, '<[^>]*>', ' ', 'g')"
    return SQUEEZE.format(UNESCAPE.format(tagless))


def _read(spark, sf_dir, selectors, cap):
    return read_articles(A.page_payloads(spark, sf_dir, selectors, cap))


@query("s5_page_articles", f"""
WITH a AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)(</article>|<footer>|$)', 1) AS body FROM pages
  WHERE html LIKE '%<article>%')
SELECT page_id, 'site-' || CAST(page_id AS VARCHAR) || '-0' AS id, url,
  {text_sql("regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1)")} AS title,
  {text_sql("regexp_replace(body, '(?s)^.*?</h1>', '')")} AS content
FROM a
""")
def s5_page_articles(spark, sf_dir):
    """One article per page: heading, all paragraphs, and the page's own url as it has no link of its own."""
    items = article_items(_read(spark, sf_dir, ARTICLE, 10))
    return items.select(F.col("source_ord").alias("page_id"), "id", "url", "title", "content")


@query("l2_nav_links", r"""
WITH nav AS (SELECT page_id, url, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS body FROM pages),
hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(body, '<li><a href="([^"]*)"', 1)) AS href,
  generate_subscripts(regexp_extract_all(body, '<li><a href="([^"]*)"', 1), 1) AS place FROM nav)
SELECT page_id, 'site-' || CAST(page_id AS VARCHAR) || '-' || CAST(place - 1 AS VARCHAR) AS id,
  CASE WHEN href LIKE 'http%' THEN href ELSE
    CASE WHEN url LIKE '%/' THEN url ELSE url || '/' END || regexp_replace(href, '^/', '') END AS url
FROM hrefs WHERE place <= 4
""")
def l2_nav_links(spark, sf_dir):
    """The first four navigation links of each page; relative ones are put behind the page's url."""
    articles = cap_per_source(_read(spark, sf_dir, LINKS, 4), 4)
    return article_items(articles).select(F.col("source_ord").alias("page_id"), "id", "url")


@query("p10_article_urls", """
WITH h AS (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'http://z.example/a' WHEN 2 THEN '/a/b'
  WHEN 3 THEN 'a' WHEN 4 THEN '' ELSE '//a' END AS href, CASE WHEN url LIKE '%/' THEN url ELSE url || '/' END AS base FROM pages)
SELECT page_id, 'hacker-news-' || CAST(page_id AS VARCHAR) AS id, CASE WHEN href IS NULL THEN url WHEN href LIKE 'http%' THEN href
  ELSE base || regexp_replace(href, '^/', '') END AS article_url FROM h
""")
def p10_article_urls(spark, sf_dir):
    href = A.by_value(F.col("page_id") % 6, {1: "http://z.example/a", 2: "/a/b", 3: "a", 4: "", 5: "//a"})
    return A.table(spark, sf_dir, "pages").select(
        "page_id", article_id(F.lit("Hacker News"), F.col("page_id")).alias("id"),
        article_url(href, F.col("url")).alias("article_url"),
    )


@query("p12_author_places", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob B.' WHEN 2 THEN 'Cy' END AS author FROM pages
""")
def p12_author_places(spark, sf_dir):
    """Author places put in front of each page's article text; the first that is not blank counts."""
    places = A.by_value(F.col("source_ord") % 4, {
        0: '<i class="author"> </i><b rel="author">Ann</b><u class="byline">no</u>',
        1: '<div class="x byline"><span>Bob</span> B.</div><p class="meta-author">no</p>',
        2: '<span class=meta-author>Cy</span>',
        3: '<span class="authors">no</span><i class="byline">&nbsp;</i>',
    })
    pages = A.page_payloads(spark, sf_dir, ARTICLE, 10)
    marked = pages.withColumn("body", F.replace("body", F.lit("<h1>"), F.concat(places, F.lit("<h1>"))))
    articles = read_articles(marked)
    return articles.select(F.col("source_ord").alias("page_id"), first_author().alias("author"))
