from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidings.functions import dates, text, urls
from tidings.operators.recency import in_calendar_days, is_recent, run_days, since_cutoff
from tidings.sources.config import sort_key

AS_OF = "2025-05-23 08:16:26"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def many(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def stamp(value):
    return F.lit(value).cast("timestamp")


@pytest.mark.parametrize("published, days, kept", [
    ("2025-05-22 00:00:00", 1, True), ("2025-05-21 23:59:59.999999", 1, False),
    ("2025-05-22 23:59:59.999999", 1, True), ("2025-05-23 00:00:00", 1, False),
    ("2025-05-21 00:00:00", 2, True), ("2025-05-22 12:00:00", 0, False), (None, 1, False),
])
def test_calendar_window(spark, published, days, kept):
    inside = in_calendar_days(stamp(published), stamp(AS_OF), days)
    assert spark.range(1).filter(inside).count() == kept
    assert spark.range(1).filter(in_calendar_days(stamp(published), stamp(AS_OF), days, most_days=7)).count() == kept


def test_calendar_window_on_the_day_clocks_change(spark):
    as_of = stamp("2025-03-10 16:00:00")
    edges = ["2025-03-09 04:59:59", "2025-03-09 05:00:00", "2025-03-10 03:59:59", "2025-03-10 04:00:00"]
    got = [one(spark, in_calendar_days(stamp(e), as_of, 1, "America/New_York")) for e in edges]
    assert got == [False, True, True, False]


@pytest.mark.parametrize("published, kept", [
    ("2025-05-22 08:16:26", True), ("2025-05-22 08:16:25", False), ("2025-05-22 08:16:25.999", False),
    ("2025-05-22 08:16:26.9", True), ("2025-05-23 08:00:00", True), ("2026-01-01 00:00:00", True),
])
def test_rolling_cutoff(spark, published, kept):
    assert one(spark, since_cutoff(stamp(published), stamp(AS_OF + ".7"), 1)) is kept


@pytest.mark.parametrize("kind, published, kept", [
    ("rss", None, False), ("youtube", None, False), ("reddit", None, True), ("scrape", None, True),
    ("scrape", "1999-01-01 00:00:00", True), ("rss", AS_OF, False), ("reddit", AS_OF, True),
])
def test_policy_by_type(spark, kind, published, kept):
    assert spark.range(1).filter(is_recent(F.lit(kind), stamp(published), stamp(AS_OF), 1)).count() == kept


def test_run_days_agree_with_the_window(spark):
    items = spark.createDataFrame([("a", "2025-05-20 23:59:59"), ("b", "2025-05-22 00:00:00"), ("c", None)], "id string, p string")
    items = items.withColumn("publish_date", F.col("p").cast("timestamp"))
    got = sorted((r["id"], str(r["run_date"])) for r in run_days(items, 2).collect())
    assert got == [("a", "2025-05-21"), ("a", "2025-05-22"), ("b", "2025-05-23"), ("b", "2025-05-24")]
    for name, day in got:
        window = in_calendar_days(F.col("publish_date"), stamp(day + " 09:00:00"), 2)
        assert items.filter(window).filter(F.col("id") == name).count() == 1
    assert run_days(items, 0).count() == 0


def test_scraped_dates(spark):
    utc = dt.datetime(2025, 5, 22, 5, 44, 39)
    good = ["2025-05-22T05:44:39Z", "2025-05-22T05:44:39+02:00", "2025-05-22T05:44Z", "2025-05-22T05:44:39.5Z",
            "2025-05-22T07:44:39+02:00[Europe/Paris]"]
    want = [utc, utc.replace(hour=3), utc.replace(second=0), utc.replace(microsecond=500000), utc]
    assert many(spark, good, dates.scraped_date) == want
    bad = ["2025-05-22T05:44:39", "2025-05-22", "2025-05-22 01:02:03", "May 3, 2025", "MAY", "", None, "2025-13-40T05:44:39Z"]
    assert many(spark, bad, dates.scraped_date) == [None] * len(bad)
    loose = many(spark, bad[:5], lambda c: dates.scraped_date(c, lenient=True))
    assert loose == [utc, dt.datetime(2025, 5, 22), dt.datetime(2025, 5, 22, 1, 2, 3), dt.datetime(2025, 5, 3), None]


def test_feed_dates(spark):
    texts = ["Thu, 22 May 2025 05:44:39 GMT", "Fri, 23 May 2025 05:44:39 +0200", "Fri, 3 Jan 2025 05:44:39 EST", "junk",
             "Thu, 22 May 25 05:44 UT", "2025-05-22T05:44:39Z", None]
    got = many(spark, texts, dates.feed_date)
    assert got == [
        dt.datetime(2025, 5, 22, 5, 44, 39), dt.datetime(2025, 5, 23, 3, 44, 39), dt.datetime(2025, 1, 3, 10, 44, 39), None,
        dt.datetime(2025, 5, 22, 5, 44), dt.datetime(2025, 5, 22, 5, 44, 39), None,
    ]


@pytest.mark.parametrize("instant, zone, want", [
    ("2025-05-22 05:44:39", "UTC", "2025-05-22T05:44:39Z[UTC]"),
    ("2025-05-22 05:44:00.120", "Z", "2025-05-22T05:44:00.12Z"),
    ("2025-05-22 05:44:39", "Europe/Paris", "2025-05-22T07:44:39+02:00[Europe/Paris]"),
    ("2025-05-22 05:44:39", "-03:30", "2025-05-22T02:14:39-03:30"),
    ("2025-05-22 05:44:39.000001", "+05:45", "2025-05-22T11:29:39.000001+05:45"),
])
def test_zoned_text_round_trip(spark, instant, zone, want):
    zoned = dates.zoned_text(stamp(instant), F.lit(zone))
    assert one(spark, zoned) == want
    assert one(spark, dates.iso_zoned(F.lit(want)) == stamp(instant))
    assert one(spark, dates.iso_zone(F.lit(want))) == zone


def test_preview(spark):
    long, wide = "a" * 201, "\U0001F600" * 100
    texts = ["", "a" * 200, long, wide, wide + "x", "a" * 199 + "\U0001F600", "a" * 198 + "\U0001F600" + "bc"]
    assert many(spark, texts, text.preview) == [
        "", "a" * 200, "a" * 200 + "...", wide, wide + "...", "a" * 199 + "?...", "a" * 198 + "\U0001F600...",
    ]


def test_source_line(spark):
    none = F.lit(None)
    assert one(spark, text.source_line(F.lit("S"), none.cast("string"), none.cast("timestamp"), F.lit("UTC"))) == "From S  "
    late = stamp("2025-05-21 23:30:00")
    assert one(spark, text.source_line(F.lit("S"), F.lit("A"), late, F.lit("Europe/Paris"))) == "From S by A on 2025-05-22"


def test_article_id_and_metadata(spark):
    assert one(spark, text.article_id(F.lit("Hacker News"), F.lit(2))) == "hacker-news-2"
    pairs = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))
    assert one(spark, text.metadata_text(pairs)) == "{b=1, a=2}"
    assert one(spark, text.metadata_text(F.create_map().cast("map<string,string>"))) == "{}"


def test_blank(spark):
    values = [None, "", " \t\n", "  \x1c", "\u0085", "a", " a "]
    assert many(spark, values, text.is_blank) == [True, True, True, True, False, False, False]


@pytest.mark.parametrize("href, want, resolved", [
    ("http://z", "http://z", "http://z"), ("/a", "https://x/y/a", "https://x/a"), ("a", "https://x/y/a", "https://x/a"),
    (None, "https://x/y", "https://x/y"), ("", "https://x/y/", "https://x/y"), ("//c/d", "https://x/y//c/d", "https://c/d"),
])
def test_article_url(spark, href, want, resolved):
    link, page = F.lit(href).cast("string"), F.lit("https://x/y")
    assert one(spark, urls.article_url(link, page)) == want
    assert one(spark, urls.article_url(link, page, "rfc")) == resolved
    assert one(spark, urls.article_url(F.lit("a"), F.lit("https://x/y/"))) == "https://x/y/a"


def test_sort_key(spark):
    assert many(spark, [None, "HOT", "best", "Controversial"], sort_key) == ["new", "hot", "new", "controversial"]


def test_title_key(spark):
    assert many(spark, ["Foo: Bar!", " foo  bar ", "!!!", "Über-Öl 2.0"], text.title_key) == ["foo bar", "foo bar", "", "über öl 2 0"]
