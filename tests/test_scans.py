from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidings.functions.text import metadata_text
from tidings.operators import normalize, resolve
from tidings.operators.enrich import add_transcripts, basis
from tidings.plans.daily import Options, collect_items, publish_run, publish_without_model
from tidings.sources import feed
from tidings.sources.archive import read_archive
from tidings.sources.config import config_facts, read_config, read_prompt, split_sources
from tidings.sources.feed import feed_errors, read_feeds

from conftest import rows

AS_OF = "2025-05-23 08:16:26"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


RSS = """<?xml version="1.0"?><!-- made by hand --><rss xmlns:dc="d" xmlns:content="c"><channel><title>T</title>
<item><title>a</title><link>l1</link><pubDate>Thu, 22 May 2025 05:44:39 GMT</pubDate><content:encoded>x &lt;feed&gt;</content:encoded></item>
<item><title>b</title><link>l2</link><guid>g2</guid><description></description><content:encoded>x</content:encoded>
  <category>ai</category><category>ml</category><pubDate>Thu, 22 May 2025 06:00:00 GMT</pubDate></item>
<item><title>c</title><guid>https://perma.example/c</guid><author>Bo</author></item>
<item><link>l4</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><id>i</id><title>t</title>
<link rel="self" href="s"/><link href="l"/><published>2025-05-22T05:44:39Z</published><summary>s</summary></entry></feed>"""


def feeds(spark):
    bodies = [("rss", 0, RSS), ("atom", 1, ATOM), ("torn", 2, RSS[:150]), ("html", 3, "<html><body>x</body></html>"), ("null", 4, None)]
    df = spark.createDataFrame(bodies, "source_name string, source_ord int, body string")
    return df.withColumns({"as_of": as_of(), "run_date": F.to_date(as_of()), "page_no": F.lit(0)})


def test_feeds_of_both_dialects(spark):
    items = normalize.feed_items(read_feeds(feeds(spark)).filter(feed.complete()))
    got = rows(items, "source_name", "item_pos", "id", "content", "url", "author", metadata_text(F.col("metadata")))
    assert got == [
        ("atom", 0, "i", "s", "l", "", "{feedTitle=A, feedDescription=, categories=}"),
        ("rss", 0, "l1", "x <feed>", "l1", "", "{feedTitle=T, feedDescription=, categories=}"),
        ("rss", 1, "g2", "", "l2", "", "{feedTitle=T, feedDescription=, categories=ai, ml}"),
        ("rss", 2, "https://perma.example/c", "", "https://perma.example/c", "Bo",
         "{feedTitle=T, feedDescription=, categories=}"),
    ]


def test_feed_faults_are_rows(spark):
    got = rows(feed_errors(feeds(spark)), "source_name", "reason")
    assert got == [("html", "unreadable feed"), ("null", "unreadable feed"),
                   ("rss", "entry without title or link: l4"), ("torn", "unreadable feed")]


RDF = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:dc="d" xmlns="http://purl.org/rss/1.0/">
<channel rdf:about="c"><title>T1</title><description>about</description></channel>
<item rdf:about="u1"><title>a</title><link>l1</link><description>d</description><dc:date>2025-05-22T05:44:39Z</dc:date>
  <dc:creator>Cy</dc:creator><dc:subject>ai</dc:subject></item>
<item rdf:about="u2"><title>b</title><link>l2</link></item></rdf:RDF>"""


def test_items_beside_their_channel(spark):
    odd = "<other><channel><title>T</title><item><title>a</title><link>l</link></item></channel></other>"
    df = feeds(spark).limit(0).unionByName(
        spark.createDataFrame([("rdf", 0, RDF), ("odd", 1, odd)], "source_name string, source_ord int, body string").withColumns(
            {"as_of": as_of(), "run_date": F.to_date(as_of()), "page_no": F.lit(0)}))
    items = normalize.feed_items(read_feeds(df).filter(feed.complete()))
    assert rows(items, "source_name", "id", "title", "url", "author", F.col("publish_date").cast("string"), metadata_text(F.col("metadata"))) == [
        ("rdf", "u1", "a", "l1", "Cy", "2025-05-22 05:44:39", "{feedTitle=T1, feedDescription=about, categories=ai}"),
        ("rdf", "u2", "b", "l2", "", None, "{feedTitle=T1, feedDescription=about, categories=}")]
    assert rows(feed_errors(df), "source_name", "reason") == [("odd", "unreadable feed")]


def post(i, created, **more):
    base = {"id": f"p{i}", "title": f"t{i}", "author": "u", "url": f"u{i}", "created": created, "score": i,
            "num_comments": 2, "over_18": False, "extra": [1]}
    return {"kind": "t3", "data": {**base, **more}}


def page(posts, after=None):
    return json.dumps({"kind": "Listing", "data": {"after": after, "before": None, "children": posts, "dist": 1}})


def test_post_texts_by_path(spark):
    values = [None, "", "  ", "a"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "score int, selftext string").withColumns({
        "id": F.col("score").cast("string"), "title": F.lit("t"), "url": F.lit("u"), "author": F.lit("x"),
        "created": F.lit(1747800000.9), "num_comments": F.lit(1), "over_18": F.lit(True), "subreddit": F.lit("r"),
        "source_name": F.lit("s"), "run_date": F.to_date(as_of()), "as_of": as_of(), "source_ord": F.lit(0),
        "page_no": F.lit(0), "item_pos": F.lit(0),
    })
    client, direct = (normalize.post_items(df, p) for p in ("client", "direct"))
    none = "[No content]"
    assert [r[1] for r in rows(client, "id", "content")] == [none, none, none, "a"]
    assert [r[1] for r in rows(direct, "id", "content")] == [none, "", "  ", "a"]
    assert {r[0] for r in rows(client, F.date_format("publish_date", "HH:mm:ss.SSS"))} == {"04:00:00.900"}
    assert {r[0] for r in rows(direct, F.date_format("publish_date", "HH:mm:ss.SSS"))} == {"04:00:00.000"}
    assert rows(direct, metadata_text(F.col("metadata")))[3] == ("{subreddit=r, score=3, commentCount=1, isNsfw=true}",)


def test_channel_resolution(spark):
    sources = spark.createDataFrame(
        [("exact", None, "@Abc"), ("first", " ", "nope"), ("lost", None, "@zip"), ("given", "id1", "@Abc"), ("none", None, " ")],
        "source_name string, channel_id string, channel_handle string").withColumn("source_type", F.lit("youtube"))
    candidates = spark.createDataFrame(
        [("@Abc", 1, "c1", "abcd"), ("@Abc", 2, "c2", "ABC"), ("@Abc", 3, "c3", "abc"), ("nope", 1, "z1", "zzz"),
         ("nope", 2, "z2", "my nope"), ("nope", 6, "z6", "nope")], "handle string, rank int, channel_id string, title string")
    found, errors = resolve.resolve_channels(sources, candidates)
    assert rows(found, "source_name", "channel_id") == [("exact", "c2"), ("first", "z1"), ("given", "id1")]
    assert rows(errors, "source_name", "reason") == [("lost", "no channel for handle @zip")]


def test_transcripts(spark):
    videos = spark.createDataFrame([("a", {"k": "1"}, "c"), ("b", {"transcription": "old", "k": "1"}, "c"), ("c", {}, "c")],
                                   "url string, metadata map<string,string>, content string")
    said = spark.createDataFrame([("a", "x"), ("b", "y"), ("q", "z")], "url string, transcript string")
    got = add_transcripts(videos, said)
    assert rows(got, "url", metadata_text(F.col("metadata")), basis()) == [
        ("a", "{k=1, transcription=x}", "x"), ("b", "{k=1, transcription=y}", "y"), ("c", "{}", "c")]


CONFIG = {
    "sources": [
        {"name": "Feed", "type": "rss", "url": "https://f.example", "maxResults": 2, "timeRangeDays": 1, "what": 1},
        {"name": "Broken", "type": "rss", "url": " "},
        {"name": "Forum", "type": "reddit", "subreddit": "forum", "sortBy": "TOP", "maxResults": 3, "timeRangeDays": 1},
        {"name": "Direct", "type": "reddit", "subreddit": "direct", "timeRangeDays": 1},
        {"name": "Gone", "type": "reddit", "subreddit": "gone"},
        {"name": "Videos", "type": "youtube", "channelHandle": "@Ch", "timeRangeDays": 1, "maxResults": 1},
        {"name": "Unknown", "type": "youtube", "channelHandle": "@Who"},
        {"name": "Site", "type": "scrape", "url": "https://s.example/", "maxResults": 1,
         "selectors": {"articles": "article", "title": "h1", "content": "p", "date": None}},
        {"name": "Bare", "type": "scrape", "url": "https://b.example/"},
    ],
    "global": {"cacheTimeMinutes": 5}, "llm": {"provider": "x"}, "other": {},
}


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("config") / "config.json"
    path.write_text(json.dumps(CONFIG, indent=2))
    return read_config(spark, str(path))


def test_config(spark, sources):
    assert config_facts(sources) == (9, 10)
    got = rows(sources, "source_ord", "source_name", "sort_by", "max_results", "time_range_days", "client_type")
    assert got[2:4] == [(2, "Forum", "top", 3, 1, "http"), (3, "Direct", "new", 10, 1, "http")]
    valid, errors = split_sources(sources)
    assert rows(errors, "source_name", "reason") == [
        ("Bare", "page without selectors"), ("Broken", "feed without a url")]
    assert valid.count() == 7


@pytest.mark.parametrize("entry", [
    {"name": "x", "type": "podcast"}, {"name": "x", "type": "RSS"}, {"type": "rss"}, {"name": "x", "type": "rss", "clientType": "ftp"},
    {"name": "x", "type": "scrape", "selectors": {"articles": "a"}},
])
def test_invalid_entries_abort(spark, tmp_path, entry):
    (tmp_path / "c.json").write_text(json.dumps({"sources": [entry]}))
    with pytest.raises(Exception, match="invalid source entry"):
        read_config(spark, str(tmp_path / "c.json")).collect()


def test_missing_or_torn_config_aborts(spark, tmp_path):
    with pytest.raises(Exception):
        read_config(spark, str(tmp_path / "none.json")).collect()
    (tmp_path / "c.json").write_text('{"sources": [')
    with pytest.raises(Exception):
        read_config(spark, str(tmp_path / "c.json")).collect()


def test_prompt_file(spark, tmp_path):
    (tmp_path / "prompt.md").write_text("line one\n\nline two\n")
    assert rows(read_prompt(spark, str(tmp_path / "prompt.md"))) == [("line one\n\nline two\n",)]
    with pytest.raises(Exception):
        read_prompt(spark, str(tmp_path / "none.md")).collect()


def landed(spark):
    day = 86400
    now = 1747988186  # 2025-05-23 08:16:26 UTC
    body = "<rss><channel><title>F</title>" + "".join(
        f"<item><title>f{i}</title><link>l{i}</link><pubDate>{d} May 2025 10:00:00 GMT</pubDate></item>"
        for i, d in enumerate([21, 22, 23, 22, 22])) + "</channel></rss>"
    videos = json.dumps({"items": [
        {"id": {"videoId": f"v{i}"}, "snippet": {
            "title": f"video {i}", "description": "d", "publishedAt": d, "channelId": "c", "channelTitle": "C",
            "thumbnails": {"high": {"url": "t"}}}} for i, d in enumerate(["2025-05-23T01:00:00Z", "2025-05-22T01:00:00Z", "bad", "2025-05-22T00:30:00Z"])
    ] + [{"id": {"videoId": "nothumb"}, "snippet": {"title": "x", "publishedAt": "2025-05-22T02:00:00Z"}}]})
    site = "<article><h1>Head</h1><p>a<p>b</article><article><h1>Two</h1></article>"
    data = [
        ("Feed", "rss", "http", 0, body), ("Broken", "rss", "http", 0, body),
        ("Forum", "reddit", "client", 0, page([post(0, now - 2 * day), post(1, now - day), post(2, now)], "x")),
        ("Forum", "reddit", "client", 1, page([post(3, now + 0.5), post(4, now), post(5, now, url=None)], None)),
        ("Forum", "reddit", "direct", 0, page([post(9, now)])),
        ("Direct", "reddit", "client", 0, "{torn"),
        ("Direct", "reddit", "direct", 0, page([post(6, now)], "x")),
        ("Direct", "reddit", "direct", 1, page([post(7, now)], None)),
        ("Gone", "reddit", "client", 0, "nothing"), ("Gone", "reddit", "direct", 0, "{"),
        ("Videos", "youtube", "http", 0, videos), ("Unknown", "youtube", "http", 0, videos),
        ("Site", "scrape", "http", 0, site), ("Stranger", "rss", "http", 0, body),
    ]
    return spark.createDataFrame(data, "source_name string, source_type string, path string, page_no int, body string").withColumn(
        "fetched_at", as_of()).repartition(3)


@pytest.fixture(scope="module")
def run(spark, sources):
    candidates = spark.createDataFrame([("@Ch", 1, "ch", "ch")], "handle string, rank int, channel_id string, title string")
    said = spark.createDataFrame([("https://www.youtube.com/watch?v=v1", "spoken")], "url string, transcript string")
    return collect_items(landed(spark), sources, as_of(), candidates, said)


def test_whole_run(run):
    got = [tuple(r) for r in run.items.orderBy("source_ord", "page_no", "item_pos").select(
        "source_name", "title", "content", "author").collect()]
    assert got == [
        ("Feed", "f1", "", ""), ("Feed", "f3", "", ""),
        ("Forum", "t1", "[No content]", "u"), ("Forum", "t2", "[No content]", "u"), ("Forum", "t3", "[No content]", "u"),
        ("Direct", "t6", "[No content]", "u"), ("Direct", "t7", "[No content]", "u"),
        ("Gone", "Unable to retrieve content from r/gone", normalize.PLACEHOLDER_CONTENT, "system"),
        ("Videos", "video 1", "d", "C"),
        ("Site", "Head", "a b", None),
    ]


def test_errors_of_a_run(run):
    assert rows(run.errors, "source_name", "stage", "reason") == sorted([
        ("Bare", "config", "page without selectors"),
        ("Broken", "config", "feed without a url"),
        ("Direct", "listing", "unreadable page"), ("Gone", "listing", "unreadable page"), ("Gone", "listing", "unreadable page"),
        ("Forum", "listing", "post with missing fields: p5"),
        ("Videos", "video", "video with missing fields: nothumb"),
        ("Unknown", "channel", "no channel for handle @Who"),
    ], key=repr)


def test_sources_of_which_nothing_landed(spark, sources):
    some = landed(spark).filter("source_name not in ('Forum', 'Site')")
    run = collect_items(some, sources, as_of())
    assert rows(run.items.filter("author = 'system'"), "source_name", metadata_text(F.col("metadata"))) == [
        ("Forum", "{subreddit=forum, error=API access failed: no payload landed}"),
        ("Gone", "{subreddit=gone, error=API access failed: unreadable listing}")]
    assert rows(run.errors.filter("stage = 'landing'"), "source_name") == [("Forum",), ("Site",)]
    backfill = collect_items(some, sources)
    assert rows(backfill.items.filter("author = 'system'"), "source_name") == [("Gone",)]


def test_backfill_equals_its_days(spark, sources):
    """Payloads fetched on two days, without a run time: each day as if it was run alone."""
    one = landed(spark)
    two = one.withColumn("fetched_at", F.expr("fetched_at - interval 1 day"))
    both = collect_items(one.unionByName(two), sources).items
    days = [collect_items(day, sources).items for day in (one, two)]
    assert rows(both, "run_date", "source_name", "id", "title") == sorted(
        rows(days[0], "run_date", "source_name", "id", "title") + rows(days[1], "run_date", "source_name", "id", "title"), key=repr)
    assert both.select("run_date").distinct().count() == 2


def test_a_run_reads_its_own_fetch(spark, sources):
    """The last fetch up to the run's time replaces earlier ones; older and later ones belong to other runs."""
    own = landed(spark)
    stale = own.filter("source_name in ('Feed', 'Forum', 'Site')")
    history = [stale.withColumn("fetched_at", F.col("fetched_at") + F.expr(f"interval {h} hours")) for h in (-48, -2, 3)]
    mixed = own
    for fetch in history:
        mixed = mixed.unionByName(fetch)
    alone, among = (collect_items(p, sources, as_of()).items for p in (own, mixed))
    columns = ("source_ord", "page_no", "item_pos", "id", "title")
    assert rows(among.filter("author <> 'system' or author is null"), *columns) == rows(
        alone.filter("author <> 'system' or author is null"), *columns)
    assert rows(collect_items(mixed, sources).items.groupBy("run_date", "source_name", "id").count().filter("count > 1")) == []


def fetched(spark, *pages):
    """Pages as ``(page_no, seconds, body)`` of one listing."""
    at = dt.datetime(2025, 5, 23, 6, 0)
    data = [("Forum", "reddit", "client", n, at + dt.timedelta(seconds=s), b) for n, s, b in pages]
    return spark.createDataFrame(data, "source_name string, source_type string, path string, page_no int, fetched_at timestamp, body string")


@pytest.mark.parametrize("pages, wanted, torn", [
    ([(0, 0, "a"), (1, 4, "b"), (2, 9, "c")], ["a", "b", "c"], 0),
    # An older fetch is replaced whole, also where the new one has fewer pages.
    ([(1, -3600, "x"), (2, -3590, "y"), (3, -3580, "z"), (1, 0, "a"), (2, 2, "b")], ["a", "b"], 0),
    # A second try without its first page, or with a gap, doesn't replace a whole fetch; a first page by itself does.
    ([(1, 0, "a"), (2, 2, "b"), (2, 1800, "x"), (3, 1802, "y")], ["a", "b"], 0),
    ([(0, 0, "a"), (1, 2, "b"), (0, 1800, "x"), (2, 1802, "y")], ["a", "b"], 0),
    ([(0, 0, "a"), (0, 1800, "x")], ["x"], 0),
    # Nothing whole: the last one, with an error row. A page read twice within a fetch comes once, as it was read last.
    ([(0, 0, "a"), (2, 2, "b"), (3, 1800, "x")], ["x"], 1),
    ([(0, 0, "old"), (0, 1, "a"), (1, 2, "b")], ["a", "b"], 0),
    # Pauses below the gap in a row make one long fetch; its pages lie in several slots.
    ([(n, n * 500, str(n)) for n in range(6)], list("012345"), 0),
])
def test_pages_of_a_fetch(spark, sources, pages, wanted, torn):
    payloads = fetched(spark, *pages)
    fetches = resolve.choose_fetches(payloads, as_of())
    bound = resolve.bind(payloads, split_sources(sources)[0], as_of(), fetches=fetches)
    assert [r["body"] for r in bound.orderBy("page_no").select("body").collect()] == wanted
    assert fetches.missing_pages().count() == torn


def test_fetches_that_are_named(spark, sources):
    pages = [(0, 0, "a", 1, 2), (1, 2, "b", 1, 2), (0, 3, "x", 2, 2)]
    payloads = fetched(spark, *[p[:3] for p in pages]).join(
        spark.createDataFrame([p[2:] for p in pages], "body string, fetch_id long, page_count long"), "body")
    bound = resolve.bind(payloads, split_sources(sources)[0], as_of())
    assert sorted(r["body"] for r in bound.select("body").collect()) == ["a", "b"]
    assert "fetch_id" not in bound.columns


def test_history_is_cut_at_the_scan(spark, tmp_path):
    landed(spark).write.parquet(str(tmp_path / "history"))
    plan = resolve.of_run(spark.read.parquet(str(tmp_path / "history")), as_of())._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters:")[1]
    assert "LessThanOrEqual(fetched_at" in pushed and "GreaterThan(fetched_at" in pushed


def test_sources_of_one_name(spark, sources):
    feed_source = sources.filter("source_name = 'Feed'")
    second = feed_source.withColumn("source_ord", F.lit(90))
    twins = feed_source.unionByName(second)
    payload = landed(spark).filter("source_name = 'Feed'")
    by_name = collect_items(payload, twins, as_of())
    assert rows(by_name.items, "title") == [("f1",), ("f3",)]
    assert rows(by_name.errors, "source_name", "stage", "reason") == [("Feed", "config", "another source has this name")]
    told = collect_items(payload.withColumn("source_ord", F.lit(90)), twins, as_of())
    assert rows(told.items, "source_ord", "title") == [(90, "f1"), (90, "f3")]
    assert rows(told.errors, "source_name", "stage") == [("Feed", "landing")]


def test_faults_of_scraped_pages_stay_with_their_source(spark, sources):
    site = sources.filter("source_name = 'Site'")
    bad = site.withColumns({"source_name": F.lit("Bad"), "source_ord": F.lit(80),
                            "selectors": F.col("selectors").withField("articles", F.lit("article:first-child"))})
    void = site.withColumns({"source_name": F.lit("Void"), "source_ord": F.lit(81)})
    page_of = landed(spark).filter("source_name = 'Site'")
    payloads = page_of.unionByName(page_of.withColumn("source_name", F.lit("Bad"))).unionByName(
        page_of.withColumns({"source_name": F.lit("Void"), "body": F.lit(None).cast("string")}))
    run = collect_items(payloads, site.unionByName(bad).unionByName(void), as_of())
    assert rows(run.items, "source_name", "title") == [("Site", "Head")]
    assert rows(run.errors, "source_name", "stage", "reason") == [
        ("Bad", "config", "unsupported selector"), ("Void", "page", "unreadable page")]


@pytest.mark.parametrize("selector", [
    "a", "*", ".x.y", "div#i > p.q, li", "[rel=author]", "[data-x='1'] a", "a:first-child", "a[x^=y]", "a + b", "a ~ b", "[a=x y]", "", "h1,", "ü"])
def test_selector_check_agrees_with_the_matcher(spark, selector):
    from tidings.functions import html
    from tidings.sources.config import unreadable_selectors

    try:
        html.select(html.parse("<a></a>"), selector)
        refused = False
    except ValueError:
        refused = True
    df = spark.range(1).select(F.struct(F.lit(selector).alias("articles"), *[F.lit(None).cast("string").alias(n) for n in ("title", "content", "date")]).alias("selectors"))
    assert df.select(unreadable_selectors()).first()[0] == refused


@pytest.mark.parametrize("path", ["client", "direct"])
def test_a_torn_page_that_no_run_reads(spark, sources, path):
    """``Forum`` (at most 3 posts): the run stops after two pages, so a torn third does not matter, a torn second does."""
    now = landed(spark).selectExpr("unix_seconds(max(fetched_at))").first()[0]
    good = [page([post(1, now), post(2, now)], "x"), page([post(3, now), post(4, now)], "y")]
    for bodies, titles in (([*good, "{torn"], ["t1", "t2", "t3"]), ([good[0], "{torn", good[1]], ["placeholder"])):
        data = [("Forum", "reddit", path, n, body) for n, body in enumerate(bodies)]
        df = spark.createDataFrame(data, "source_name string, source_type string, path string, page_no int, body string")
        items = collect_items(df.withColumn("fetched_at", as_of()), sources.filter("source_name = 'Forum'"), as_of()).items
        got = [t if t.startswith("t") and len(t) == 2 else "placeholder" for (t,) in rows(items, "title")]
        assert got == titles


def test_each_branch_reads_only_its_payloads(spark, sources, tmp_path):
    """Payloads landed by type: a branch prunes the others, and bodies are not shuffled to meet their sources."""
    landed(spark).write.partitionBy("source_type").parquet(str(tmp_path / "landed"))
    stored = spark.read.parquet(str(tmp_path / "landed"))
    bound = resolve.bind(stored, split_sources(sources)[0], as_of(), config_facts(sources).sources)
    plan = bound.filter("source_type = 'rss'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_type" in plan and "= rss)" in plan.split("PartitionFilters")[1]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_original_page_rule_loses_the_last_page(spark, sources):
    run = collect_items(landed(spark), sources, as_of(), options=Options(keep_last_page=False))
    assert rows(run.items.filter("source_name = 'Direct'"), "title") == [("t6",)]


def test_run_without_model_calls_nothing(spark, run, tmp_path):
    done = publish_run(run.items, str(tmp_path))
    assert done.digests is None
    assert read_archive(spark, done.archive).count() == run.items.count()


def test_run_with_model_and_rerun(spark, run, tmp_path):
    for text in ("first", "second"):
        done = publish_run(run.items, str(tmp_path), F.lit("P"), lambda prompt: f"{text} {prompt.count('Title: ')}", as_of())
    assert rows(spark.read.parquet(done.digests), "run_date", "body") == [
        (__import__("datetime").date(2025, 5, 23), f"# News Summary - {AS_OF}\n\nsecond 10")]
    assert spark.read.text(done.index, wholetext=True).filter("value like '%(./2025-05-23-summary.md)%'").count() == 1
    assert read_archive(spark, done.archive).count() == 10


def test_run_with_rules_only(spark, run, tmp_path):
    path = publish_without_model(run.items, str(tmp_path), as_of())
    body = spark.read.parquet(path).first()["body"]
    assert body.startswith(f"# News Summary - {AS_OF}\n\n## Unified Content Digest\n")


def test_empty_run_leaves_nothing(spark, run, tmp_path):
    done = publish_run(run.items.limit(0), str(tmp_path), F.lit("P"), lambda p: "x", as_of())
    assert read_archive(spark, done.archive).count() == 0
    assert spark.read.schema("run_date date").parquet(done.digests).count() == 0


def test_caps_cut_before_each_shuffle_at_any_size(spark):
    from pyspark.sql import functions as F

    from tidings.operators.ordered import top_per_group

    df = spark.range(20000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    for cap in (50, 1000, 1001, 5000):
        top = top_per_group(df, ["g"], [F.col("v")], cap, cap, ["v"])
        assert top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 4
        assert top.count() == sum(min(cap, n) for n in (6667, 6667, 6666))


def test_a_limit_above_the_bound_is_refused(spark):
    import pytest
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from tidings.operators.ordered import top_per_group

    df = spark.range(50).select(F.lit(1).alias("g"), F.col("id").alias("v"), F.lit(20).alias("own"))
    with pytest.raises(PySparkException, match="above 10"):
        top_per_group(df, ["g"], [F.col("v")], F.col("own"), 10, ["v"]).collect()


def test_errors_come_from_one_parse_of_each_payload(spark):
    from tidings.sources.feed import feed_errors
    from tidings.sources.listing import listing_errors
    from tidings.sources.video import video_errors

    bodies = {
        "feed": [
            "<rss><channel><title>t</title><item><title>a</title><link>l</link></item><item><link>m</link></item><item><guid>g</guid></item></channel></rss>",
            "<rss><channel><item><title>a</title></item></channel></rss>", "<feed><title>t</title><entry><id>i</id></entry></feed>",
            "<feed><title>t</title></feed>", "<html/>", "", None,
        ],
        "listing": ['{"data": {"children": [{"data": {"id": "x"}}, {"data": null}, {}]}}', '{"data": {"children": []}}', "{", None],
        "video": ['{"items": [{"id": {"videoId": "v"}, "snippet": null}, {}]}', '{"items": []}', "[", None],
    }
    want = {
        "feed": ["entry without title or link: g", "entry without title or link: i", "entry without title or link: m"]
        + ["unreadable feed"] * 4,
        "listing": ["post with missing fields: ?"] * 2 + ["post with missing fields: x"] + ["unreadable page"] * 2,
        "video": ["unreadable search result"] * 2 + ["video with missing fields: ?", "video with missing fields: v"],
    }
    for errors, stage, parser in ((feed_errors, "feed", "from_xml"), (listing_errors, "listing", "from_json"), (video_errors, "video", "from_json")):
        payloads = spark.createDataFrame([("s", b) for b in bodies[stage]], "source_name string, body string")
        found = errors(payloads)
        assert sorted(r["reason"] for r in found.collect()) == want[stage]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # A feed has two dialects, of which a payload is parsed as one.
        assert plan.count(parser + "(") <= (2 if stage == "feed" else 1), plan
        assert "Union" not in plan
