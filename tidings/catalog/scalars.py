"""Scalar derivations: dates, sort words, previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.catalog import query
from tidings.catalog.sqltext import EVENTS, ts
from tidings.functions import dates
from tidings.functions.text import preview
from tidings.operators.normalize import post_items
from tidings.plans import adapters as A
from tidings.sources.config import sort_key


def moment():
    return F.col("o_orderdate")



def _orders(spark, sf_dir):
    """Orders with a time of day."""
    orders = A.table(spark, sf_dir, "orders", A.ORDERS)
    return orders.withColumn(
        "o_orderdate", F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    )


ORDERS = "ord AS (SELECT *, o_orderdate + to_seconds(o_orderkey % 86400) AS t FROM orders)"


@query("p15_feed_dates", f"""
WITH {ORDERS}
SELECT o_orderkey AS id, CASE o_orderkey % 6
  WHEN 0 THEN {ts('t')} WHEN 1 THEN {ts('t - INTERVAL 2 HOUR')} WHEN 2 THEN {ts('t + INTERVAL 5 HOUR')}
  WHEN 3 THEN {ts("date_trunc('minute', t)")} WHEN 4 THEN {ts('t')} END AS parsed
FROM ord
""")
def p15_feed_dates(spark, sf_dir):
    """RFC 822 with names and offsets, without seconds, ISO, and junk."""
    case = F.col("o_orderkey") % 6
    long = F.date_format(moment(), "EEE, d MMM yyyy HH:mm:ss")
    text = (
        F.when(case == 0, F.concat(long, F.lit(" GMT")))
        .when(case == 1, F.concat(long, F.lit(" +0200")))
        .when(case == 2, F.concat(F.date_format(moment(), "d MMM yyyy HH:mm:ss"), F.lit(" -0500")))
        .when(case == 3, F.concat(F.date_format(moment(), "EEE, dd MMM yyyy HH:mm"), F.lit(" UT")))
        .when(case == 4, F.date_format(moment(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("some day")
    )
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), A.ts_text(dates.feed_date(text)).alias("parsed"))


SCRAPED = {
    0: "yyyy-MM-dd'T'HH:mm:ss'Z'", 1: "yyyy-MM-dd'T'HH:mm:ss'+02:00'", 2: "yyyy-MM-dd'T'HH:mm:ss",
    3: "yyyy-MM-dd", 4: "yyyy-MM-dd HH:mm:ss", 5: "MMM d, yyyy", 6: "yyyy-MM-dd'T'HH:mm'-03:30[America/St_Johns]'",
}


def _scraped_text():
    case = F.col("o_orderkey") % 8
    return F.coalesce(*[F.when(case == k, F.date_format(moment(), f)) for k, f in SCRAPED.items()], F.lit(" "))


def _scraped_sql(lenient: bool) -> str:
    more = f"""WHEN 2 THEN {ts('t')} WHEN 3 THEN {ts("date_trunc('day', t)")} WHEN 4 THEN {ts('t')}
  WHEN 5 THEN {ts("date_trunc('day', t)")}""" if lenient else ""
    return f"""
WITH {ORDERS}
SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN {ts('t')} WHEN 1 THEN {ts('t - INTERVAL 2 HOUR')} {more}
  WHEN 6 THEN {ts("date_trunc('minute', t) + INTERVAL 210 MINUTE")} END AS parsed
FROM ord
"""


def _scraped(spark, sf_dir, lenient: bool):
    parsed = dates.scraped_date(_scraped_text(), lenient)
    return _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), A.ts_text(parsed).alias("parsed"))


@query("p11_scraped_dates", _scraped_sql(False))
def p11_scraped_dates(spark, sf_dir):
    return _scraped(spark, sf_dir, False)


@query("p11_scraped_dates_lenient", _scraped_sql(True))
def p11_scraped_dates_lenient(spark, sf_dir):
    return _scraped(spark, sf_dir, True)


@query("p13_zoned_dates", f"""
WITH {EVENTS}, z AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN date_trunc('second', ts) ELSE ts END AS t FROM ev),
f AS (SELECT *, rtrim(rtrim(strftime(t, '.%f'), '0'), '.') AS frac FROM z)
SELECT id, CASE event_id % 4
    WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') || frac || 'Z[UTC]'
    WHEN 1 THEN strftime(t + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') || frac || '+01:00[Europe/Paris]'
    WHEN 2 THEN strftime(t + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || frac || '+05:30'
    ELSE strftime(t - INTERVAL 210 MINUTE, '%Y-%m-%dT%H:%M:%S') || frac || '-03:30[America/St_Johns]' END AS zoned,
  {ts('t')} AS back, CASE event_id % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'Europe/Paris' WHEN 2 THEN '+05:30'
    ELSE 'America/St_Johns' END AS zone
FROM f
""")
def p13_zoned_dates(spark, sf_dir):
    """Written with its zone and read back."""
    number = F.expr("cast(id as long)")
    zone = A.by_value(number % 4, {0: "UTC", 1: "Europe/Paris", 2: "+05:30", 3: "America/St_Johns"})
    date = F.when(number % 5 == 0, F.date_trunc("second", "publish_date")).otherwise(F.col("publish_date"))
    written = A.event_items(spark, sf_dir).select("id", dates.zoned_text(date, zone).alias("zoned"))
    zoned = F.col("zoned")
    return written.select("id", "zoned", A.ts_text(dates.iso_zoned(zoned)).alias("back"), dates.iso_zone(zoned).alias("zone"))


@query("f6_sort_words", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'hot' WHEN '2-HIGH' THEN 'top' WHEN '3-MEDIUM' THEN 'rising'
  ELSE 'new' END AS sort_by, count(*) AS sources FROM orders GROUP BY 1
""")
def f6_sort_words(spark, sf_dir):
    word = A.by_value(F.col("o_orderpriority"), {"1-URGENT": "HOT", "2-HIGH": "Top", "3-MEDIUM": "rising", "5-LOW": "best"})
    orders = A.table(spark, sf_dir, "orders", A.ORDERS)
    return orders.groupBy(sort_key(word).alias("sort_by")).agg(F.count("*").alias("sources"))


@query("p7_previews", """
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '...' END AS preview FROM documents
""")
def p7_previews(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@query("thread_posts", """
SELECT CAST(conv_id AS VARCHAR) AS id, CASE WHEN trim(first_text) = '' THEN '[No content]' ELSE first_text END AS content,
  CAST(replies AS VARCHAR) AS comments
FROM (SELECT conv_id, arg_min(text, turn) AS first_text, count(*) - 1 AS replies FROM conversations GROUP BY 1)
""")
def thread_posts(spark, sf_dir):
    """Threads as posts: the first turn, and how many replies it got."""
    threads = A.thread_items(spark, sf_dir).withColumns({
        "title": F.left("selftext", F.lit(40)), "url": F.concat(F.lit("https://example.org/t/"), "id"),
        "author": F.lit("user"), "created": F.lit(0.0), "score": F.lit(0), "over_18": F.lit(False),
        "subreddit": F.lit("threads"), "source_name": F.lit("threads"), "run_date": F.to_date(A.as_of()),
        "as_of": A.as_of(), "source_ord": F.lit(0), "page_no": F.col("id").cast("long"), "item_pos": F.lit(0),
    })
    items = post_items(threads, "client")
    return items.select("id", "content", F.col("metadata")["commentCount"].alias("comments"))
