"""Scans of landed payloads and the records made of them (S1-S4, P1-P4, P6, J1, J2, J5, U3): payloads are built from
events in every dialect, scanned, and compared with the events they came from."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidings.catalog import query
from tidings.catalog.sqltext import EVENTS, ts
from tidings.functions.text import metadata_text
from tidings.operators import normalize, resolve
from tidings.operators.resolve import bind
from tidings.operators.union import union_errors
from tidings.plans import adapters as A
from tidings.plans.daily import Options, collect_items
from tidings.sources.config import parse_config, split_sources
from tidings.sources.feed import feed_errors, read_feeds
from tidings.sources.listing import listing_errors, read_listing, readable
from tidings.sources.video import read_videos, video_errors


def kind():
    return F.col("source_type")



def _published(df):
    return A.ts_text(F.col("publish_date")).alias("published")


def _config_documents(spark, sf_dir):
    """One configuration text per 20 customers; most fields are left out for some."""
    c = F.col("c_custkey")
    fields = {
        "name": F.col("c_name"),
        "type": A.by_value(c % 4, {0: "rss", 1: "reddit", 2: "youtube", 3: "scrape"}),
        "url": F.when(c % 12 == 3, "  ").when((c % 2 != 0) | (c % 8 == 0), F.concat(F.lit("https://x.example/"), c.cast("string"))),
        "subreddit": F.when(c % 3 != 0, F.lower("c_mktsegment")),
        "sortBy": A.by_value(c % 5, {0: "HOT", 1: "best", 2: "Top", 3: "rising"}),
        "clientType": F.when(c % 6 == 0, "playwright"),
        "maxResults": F.when(c % 7 != 0, (c % 30).cast("int")),
        "timeRangeDays": F.when(c % 5 != 0, (c % 4).cast("int")),
        "unknownField": F.lit("ignored"),
        "selectors": F.when(c % 16 != 7, F.struct(F.lit("article").alias("articles"), F.lit("h1").alias("title"), F.lit("p").alias("content"))),
    }
    entry = F.struct(*[v.alias(k) for k, v in fields.items()])
    customers = A.table(spark, sf_dir, "customer").select("c_custkey", entry.alias("entry"))
    documents = customers.groupBy(F.expr("c_custkey div 20").alias("doc")).agg(
        F.array_sort(F.collect_list(F.struct("c_custkey", "entry"))).alias("rows")
    )
    listed = F.transform("rows", lambda r: r["entry"])
    text = F.concat(F.to_json(F.struct(listed.alias("sources"))), F.lit("\n"))
    return documents.select("doc", text.alias("body"))


CONFIG_SQL = """
src AS (
  SELECT c_custkey // 20 AS doc, row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) - 1 AS source_ord,
    c_name AS source_name,
    CASE c_custkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'reddit' WHEN 2 THEN 'youtube' ELSE 'scrape' END AS source_type,
    CASE WHEN c_custkey % 12 = 3 THEN '  ' WHEN c_custkey % 2 <> 0 OR c_custkey % 8 = 0
      THEN 'https://x.example/' || CAST(c_custkey AS VARCHAR) END AS url,
    CASE WHEN c_custkey % 3 <> 0 THEN lower(c_mktsegment) END AS subreddit,
    CASE c_custkey % 5 WHEN 0 THEN 'hot' WHEN 2 THEN 'top' WHEN 3 THEN 'rising' ELSE 'new' END AS sort_by,
    CASE WHEN c_custkey % 6 = 0 THEN 'playwright' ELSE 'http' END AS client_type,
    CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 30 ELSE 10 END AS max_results,
    CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 4 ELSE 2 END AS time_range_days,
    CASE WHEN c_custkey % 16 <> 7 THEN 'article' END AS articles
  FROM customer)"""


@query("s1_config_scan", f"""
WITH {CONFIG_SQL}
SELECT CAST(doc AS BIGINT) AS doc, CAST(source_ord AS BIGINT) AS source_ord, source_name, source_type, url, subreddit,
  sort_by, client_type, CAST(max_results AS BIGINT) AS max_results, CAST(time_range_days AS BIGINT) AS time_range_days, articles
FROM src
""")
def s1_config_scan(spark, sf_dir):
    sources = parse_config(_config_documents(spark, sf_dir))
    return sources.select(
        "doc", F.col("source_ord").cast("long").alias("source_ord"), "source_name", "source_type", "url", "subreddit",
        "sort_by", "client_type", F.col("max_results").cast("long").alias("max_results"),
        F.col("time_range_days").cast("long").alias("time_range_days"), F.col("selectors.articles").alias("articles"),
    )


@query("f4_source_checks", f"""
WITH {CONFIG_SQL}
SELECT source_name, 'config' AS stage, CASE source_type
    WHEN 'rss' THEN 'feed without a url'
    WHEN 'reddit' THEN 'listing without a subreddit'
    ELSE CASE WHEN coalesce(trim(url), '') = '' THEN 'page without a url'
      ELSE 'page without selectors' END END AS reason
FROM src
WHERE (source_type = 'rss' AND coalesce(trim(url), '') = '') OR (source_type = 'reddit' AND subreddit IS NULL)
  OR (source_type = 'scrape' AND (coalesce(trim(url), '') = '' OR articles IS NULL))
""")
def f4_source_checks(spark, sf_dir):
    _, errors = split_sources(parse_config(_config_documents(spark, sf_dir)))
    return errors.select("source_name", "stage", "reason")


@query("s2_feed_scan", f"""
WITH {EVENTS}
SELECT source_name, CAST(event_id // 500 AS BIGINT) AS page_no,
  row_number() OVER (PARTITION BY source_ord, event_id // 500 ORDER BY event_id) - 1 AS item_pos,
  CASE WHEN event_id % 3 <> 0 THEN 'g' || id END AS uri, url AS link, event_type || ' & ' || id AS title,
  CASE WHEN event_id % 5 = 1 THEN '' WHEN event_id % 5 > 1 THEN props END AS description, props AS encoded,
  {ts("date_trunc('second', ts)")} AS published,
  CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS author
FROM ev WHERE source_type = 'rss'
""")
def s2_feed_scan(spark, sf_dir):
    entries = read_feeds(A.feed_payloads(A.events(spark, sf_dir).filter(kind() == "rss")))
    return entries.select(
        "source_name", "page_no", F.col("item_pos").cast("long").alias("item_pos"), "uri", "link", "title",
        "description", "encoded", _published(entries), "author",
    )


@query("p1_feed_items", f"""
WITH {EVENTS}
SELECT CASE WHEN event_id % 3 <> 0 THEN 'g' || id ELSE url END AS id, event_type || ' & ' || id AS title,
  CASE WHEN event_id % 5 = 1 THEN '' ELSE props END AS content, url, {ts("date_trunc('second', ts)")} AS published,
  '{{feedTitle=Feed of ' || source_name || ', feedDescription=' || CASE WHEN source_ord % 2 = 0 THEN 'even feed' ELSE '' END
    || ', categories=' || CASE WHEN event_id % 6 = 0 THEN event_type || ', even' WHEN event_id % 2 = 0 THEN event_type
    ELSE '' END || '}}' AS metadata
FROM ev WHERE source_type = 'rss'
""")
def p1_feed_items(spark, sf_dir):
    payloads = A.bound(A.feed_payloads(A.events(spark, sf_dir).filter(kind() == "rss")))
    items = normalize.feed_items(read_feeds(payloads))
    return items.select("id", "title", "content", "url", _published(items), metadata_text(F.col("metadata")).alias("metadata"))


@query("p1_atom_items", f"""
WITH {EVENTS}
SELECT 'urn:e:' || id AS id, title, CASE WHEN event_id % 5 <> 0 THEN props ELSE 'body' END AS content, url,
  {ts("date_trunc('second', ts)")} AS published, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS author,
  '{{feedTitle=Feed of ' || source_name || ', feedDescription=atom, categories=' || event_type || '}}' AS metadata
FROM ev WHERE source_type = 'rss'
""")
def p1_atom_items(spark, sf_dir):
    payloads = A.bound(A.atom_payloads(A.events(spark, sf_dir).filter(kind() == "rss")))
    items = normalize.feed_items(read_feeds(payloads))
    return items.select(
        "id", "title", "content", "url", _published(items), "author", metadata_text(F.col("metadata")).alias("metadata")
    )


def _posts(spark, sf_dir):
    payloads = A.bound(A.listing_payloads(A.events(spark, sf_dir).filter(kind() == "reddit")))
    return read_listing(payloads)


@query("s3_listing_scan", f"""
WITH {EVENTS}
SELECT source_name, CAST(event_id // 125 AS BIGINT) AS page_no,
  row_number() OVER (PARTITION BY source_ord, event_id // 125 ORDER BY event_id) - 1 AS item_pos, id, title, url,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE props END AS selftext,
  CAST(floor(value) AS BIGINT) AS score, event_id % 40 AS num_comments, event_id % 9 = 0 AS over_18,
  CASE WHEN (event_id // 125) % 17 <> 16 THEN 't3_' || CAST(event_id // 125 AS VARCHAR) END AS after
FROM ev WHERE source_type = 'reddit'
""")
def s3_listing_scan(spark, sf_dir):
    return _posts(spark, sf_dir).select(
        "source_name", "page_no", F.col("item_pos").cast("long").alias("item_pos"), "id", "title", "url", "selftext",
        F.col("score").cast("long").alias("score"), F.col("num_comments").cast("long").alias("num_comments"),
        "over_18", "after",
    )


POST_METADATA = """'{{subreddit=' || source_name || ', score=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
    || ', commentCount=' || CAST(event_id % 40 AS VARCHAR) || ', isNsfw=' || CAST(event_id % 9 = 0 AS VARCHAR) || '}}'"""


def _post_columns(items):
    return items.select("id", "content", _published(items), "author", metadata_text(F.col("metadata")).alias("metadata"))


@query("p2_client_posts", f"""
WITH {EVENTS}
SELECT id, CASE WHEN event_id % 5 < 3 THEN '[No content]' ELSE props END AS content,
  {ts("date_trunc('millisecond', ts)")} AS published, CAST(user_id AS VARCHAR) AS author,
  {POST_METADATA.format()} AS metadata
FROM ev WHERE source_type = 'reddit'
""")
def p2_client_posts(spark, sf_dir):
    return _post_columns(normalize.post_items(_posts(spark, sf_dir), "client"))


@query("p3_direct_posts", f"""
WITH {EVENTS}
SELECT id, CASE event_id % 5 WHEN 0 THEN '[No content]' WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE props END AS content,
  {ts("date_trunc('second', ts)")} AS published, CAST(user_id AS VARCHAR) AS author,
  {POST_METADATA.format()} AS metadata
FROM ev WHERE source_type = 'reddit'
""")
def p3_direct_posts(spark, sf_dir):
    return _post_columns(normalize.post_items(_posts(spark, sf_dir), "direct"))


@query("s4_video_scan", f"""
WITH {EVENTS}
SELECT source_name, CAST(event_id // 1000 AS BIGINT) AS page_no,
  row_number() OVER (PARTITION BY source_ord, event_id // 1000 ORDER BY event_id) - 1 AS item_pos, 'v' || id AS video_id,
  title, CASE WHEN event_id % 50 <> 7 THEN {ts("date_trunc('second', ts)")} END AS published
FROM ev WHERE source_type = 'youtube'
""")
def s4_video_scan(spark, sf_dir):
    videos = read_videos(A.search_payloads(A.events(spark, sf_dir).filter(kind() == "youtube")))
    return videos.select(
        "source_name", "page_no", F.col("item_pos").cast("long").alias("item_pos"), "video_id", "title", _published(videos)
    )


@query("p4_video_items", f"""
WITH {EVENTS}
SELECT 'v' || id AS id, title, props AS content, 'https://www.youtube.com/watch?v=v' || id AS url, source_name AS author,
  '{{channelId=c' || CAST(source_ord AS VARCHAR) || ', thumbnailUrl=https://example.org/t/' || id || '}}' AS metadata
FROM ev WHERE source_type = 'youtube'
""")
def p4_video_items(spark, sf_dir):
    payloads = A.bound(A.search_payloads(A.events(spark, sf_dir).filter(kind() == "youtube")))
    items = normalize.video_items(read_videos(payloads))
    return items.select("id", "title", "content", "url", "author", metadata_text(F.col("metadata")).alias("metadata"))


def _handles(spark, sf_dir):
    """Video sources and channel candidates from customers: up to seven per handle, the exact one at any rank or none."""
    c = F.col("c_custkey")
    customers = A.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    sources = customers.select(
        F.col("c_name").alias("source_name"), c.alias("source_ord"), F.lit("youtube").alias("source_type"),
        F.when(c % 10 == 1, F.concat(F.lit("given"), c.cast("string"))).when(c % 10 == 2, " ").alias("channel_id"),
        F.when(c % 10 != 3, F.concat(F.when(c % 2 == 0, "@").otherwise(""), F.upper("c_name"))).alias("channel_handle"),
    )
    ranked = customers.filter(c % 11 != 0).withColumn("rank", F.explode(F.sequence(F.lit(1), (c % 7 + 1).cast("int"))))
    exact = F.col("rank") == c % 9
    candidates = ranked.select(
        F.concat(F.when(c % 2 == 0, "@").otherwise(""), F.upper("c_name")).alias("handle"), "rank",
        F.concat(F.lit("ch"), c.cast("string"), F.lit("-"), F.col("rank").cast("string")).alias("channel_id"),
        F.when(exact, F.lower("c_name")).otherwise(F.concat(F.lit("my "), F.col("c_name"))).alias("title"),
    )
    return sources, candidates


@query("j2_channel_resolution", """
WITH src AS (SELECT *, c_custkey % 10 = 3 AS unnamed FROM customer)
SELECT c_name AS source_name, CASE
    WHEN c_custkey % 10 = 1 THEN 'given' || CAST(c_custkey AS VARCHAR)
    WHEN c_custkey % 11 = 0 THEN NULL
    WHEN c_custkey % 9 BETWEEN 1 AND least(5, c_custkey % 7 + 1)
      THEN 'ch' || CAST(c_custkey AS VARCHAR) || '-' || CAST(c_custkey % 9 AS VARCHAR)
    ELSE 'ch' || CAST(c_custkey AS VARCHAR) || '-1' END AS channel_id,
  CASE WHEN c_custkey % 10 <> 1 AND c_custkey % 11 = 0 THEN 'no channel for handle '
    || CASE WHEN c_custkey % 2 = 0 THEN '@' ELSE '' END || upper(c_name) END AS reason
FROM src WHERE NOT unnamed
""")
def j2_channel_resolution(spark, sf_dir):
    """Sources with neither id nor handle give no row at all."""
    found, errors = resolve.resolve_channels(*_handles(spark, sf_dir))
    none = F.lit(None).cast("string")
    return found.select("source_name", "channel_id", none.alias("reason")).unionByName(
        errors.select("source_name", none.alias("channel_id"), "reason")
    )


def _listing_paths(spark, sf_dir):
    """Each listing page on two paths; some sources have an unreadable page on one or both."""
    pages = A.bound(A.listing_payloads(A.events(spark, sf_dir)))
    both = pages.withColumn("path", F.explode(F.array(F.lit("client"), F.lit("direct"))))
    torn = F.when(F.col("path") == "client", F.col("source_ord") % 3 == 0).otherwise(F.col("source_ord") % 2 == 0)
    broken = torn & (F.col("page_no") % 4 == 1)
    return both.withColumn("body", F.when(broken, F.left("body", F.lit(40))).otherwise(F.col("body")))


@query("j5_listing_paths", f"""
WITH {EVENTS}, pages_of AS (SELECT DISTINCT source_ord, source_name, event_id // 125 AS page_no FROM ev),
state AS (SELECT source_ord, source_name, bool_or(page_no % 4 = 1) AS hit FROM pages_of GROUP BY 1, 2)
SELECT source_name, CASE WHEN NOT (hit AND source_ord % 3 = 0) THEN 'client'
  WHEN NOT (hit AND source_ord % 2 = 0) THEN 'direct' END AS path FROM state
""")
def j5_listing_paths(spark, sf_dir):
    pages = _listing_paths(spark, sf_dir)
    names = pages.select("source_ord", "source_name").distinct()
    return resolve.listing_paths(pages, readable()).join(names, "source_ord").select("source_name", "path")


@query("p6_placeholders", f"""
WITH {EVENTS}, torn AS (SELECT DISTINCT source_name FROM ev
  WHERE source_ord % 6 = 0 AND (event_id // 125) % 4 = 1)
SELECT source_name, 'Unable to retrieve content from r/' || source_name AS title, 'system' AS author,
  'https://www.reddit.com/r/' || source_name || '/new' AS url, '2024-01-15 12:00:00.000000' AS published,
  '{{subreddit=' || source_name || ', error=API access failed: unreadable listing}}' AS metadata
FROM torn
""")
def p6_placeholders(spark, sf_dir):
    pages = _listing_paths(spark, sf_dir)
    lost = resolve.listing_paths(pages, readable()).filter("path is null").select("run_date", "source_ord")
    sources = pages.groupBy("run_date", "source_ord").agg(
        *[F.min(c).alias(c) for c in ("source_name", "subreddit", "sort_by", "as_of")]
    )
    unread = sources.join(lost, ["run_date", "source_ord"]).withColumn("reason", F.lit("unreadable listing"))
    items = normalize.placeholder_items(unread)
    return items.select(
        "source_name", "title", "author", "url", _published(items), metadata_text(F.col("metadata")).alias("metadata")
    )


@query("u3_unreadable_payloads", f"""
WITH {EVENTS}
SELECT source_name, CASE source_type WHEN 'rss' THEN 'feed' WHEN 'reddit' THEN 'listing' ELSE 'video' END AS stage,
  CASE source_type WHEN 'rss' THEN 'unreadable feed' WHEN 'reddit' THEN 'unreadable page'
    ELSE 'unreadable search result' END AS reason,
  CAST(count(DISTINCT event_id // CASE source_type WHEN 'rss' THEN 500 WHEN 'reddit' THEN 125 ELSE 1000 END) AS BIGINT) AS payloads
FROM ev WHERE source_type <> 'scrape'
  AND (event_id // CASE source_type WHEN 'rss' THEN 500 WHEN 'reddit' THEN 125 ELSE 1000 END) % 3 = 1
GROUP BY 1, 2, 3
""")
def u3_unreadable_payloads(spark, sf_dir):
    """Torn bodies become error rows; nothing fails."""
    rows = A.events(spark, sf_dir)

    def torn(payloads):
        cut = F.when(F.col("page_no") % 3 == 1, F.left("body", F.lit(30))).otherwise(F.col("body"))
        return payloads.withColumn("body", cut)

    errors = union_errors(
        feed_errors(torn(A.feed_payloads(rows.filter(kind() == "rss")))),
        listing_errors(torn(A.listing_payloads(rows.filter(kind() == "reddit")))),
        video_errors(torn(A.search_payloads(rows.filter(kind() == "youtube")))),
    )
    return errors.groupBy("source_name", "stage", "reason").agg(F.count("*").alias("payloads"))


def daily_inputs(spark, sf_dir, run: str = A.AS_OF):
    """Landed payloads of three kinds, and their source list."""
    rows = A.events(spark, sf_dir)
    landed = (
        A.feed_payloads(rows.filter(kind() == "rss")).withColumn("path", F.lit("http"))
        .unionByName(A.search_payloads(rows.filter(kind() == "youtube")).withColumn("path", F.lit("http")))
        .unionByName(A.listing_payloads(rows.filter(kind() == "reddit")).withColumn(
            "path", F.when(F.col("source_ord") % 2 == 0, "client").otherwise("direct")))
        .drop("source_ord").withColumn("fetched_at", A.as_of(run))
    )
    sources = A.with_settings(rows.groupBy("source_name", "source_type", "source_ord").agg(F.count("*")).drop("count(1)"))
    none = F.lit(None).cast("string")
    return landed, sources.withColumns({
        "url": F.lit("https://example.org/source"), "channel_id": F.col("source_name"), "channel_handle": none,
        "subreddit": F.col("source_name"), "sort_by": F.lit("new"), "client_type": F.lit("http"),
        "selectors": F.lit(None).cast("struct<articles:string,title:string,content:string,date:string>"),
    })


@query("daily_run_items", f"""
WITH {EVENTS}, pages_of AS (
  SELECT source_ord, event_id // 125 AS page_no, count(*) AS size, (event_id // 125) % 17 = 16 AS ended
  FROM ev WHERE source_type = 'reddit' GROUP BY ALL),
read AS (
  SELECT source_ord, page_no, coalesce(sum(size) OVER before, 0) AS seen,
    coalesce(max(CAST(ended AS INT)) OVER before, 0) AS done FROM pages_of
  WINDOW before AS (PARTITION BY source_ord ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
newest AS (
  SELECT *, row_number() OVER (PARTITION BY source_ord ORDER BY date_trunc('second', ts) DESC, event_id) AS seen
  FROM ev WHERE source_type = 'youtube' AND event_id % 50 <> 7),
found AS (
  SELECT ev.* , event_id AS place FROM ev WHERE source_type = 'rss'
    AND ts >= TIMESTAMP '2024-01-15 00:00:00' - days * INTERVAL 1 DAY AND ts < TIMESTAMP '2024-01-15 00:00:00'
  UNION ALL
  SELECT ev.*, event_id FROM ev WHERE source_type = 'reddit'
    AND date_trunc('second', ts) >= TIMESTAMP '2024-01-15 12:00:00' - days * INTERVAL 1 DAY
    AND (source_ord % 2 = 0 OR EXISTS (SELECT 1 FROM read r WHERE r.source_ord = ev.source_ord
      AND r.page_no = event_id // 125 AND r.seen < cap AND r.done = 0))
  UNION ALL
  SELECT * EXCLUDE (seen), seen FROM newest WHERE seen <= greatest(2 * cap, 50)
    AND ts >= TIMESTAMP '2024-01-15 00:00:00' - days * INTERVAL 1 DAY AND ts < TIMESTAMP '2024-01-15 00:00:00'),
capped AS (SELECT *, row_number() OVER (PARTITION BY source_ord ORDER BY place) AS rn FROM found)
SELECT source_type, source_name, title FROM capped WHERE rn <= cap
""")
def daily_run_items(spark, sf_dir):
    """The whole run over landed payloads: bind, scan, window, page rules, caps, records, union."""
    run = collect_items(*daily_inputs(spark, sf_dir), options=Options())
    return run.items.select("source_type", "source_name", F.replace("title", F.lit(" & "), F.lit(" ")).alias("title"))


@query("j1_bind_fetches", f"""
WITH {EVENTS}, found AS (
  SELECT source_ord, title, cap, row_number() OVER (PARTITION BY source_ord ORDER BY event_id) AS rn FROM ev
  WHERE source_type = 'rss' AND event_id % 3 <> 0
    AND ts >= TIMESTAMP '2024-01-15 00:00:00' - days * INTERVAL 1 DAY AND ts < TIMESTAMP '2024-01-15 00:00:00')
SELECT CAST(source_ord AS INT) AS source_ord, title FROM found WHERE rn <= cap
""")
def j1_bind_fetches(spark, sf_dir):
    """Feeds fetched the day before, early on the run's day, in time, and after it, from sources that share two names:
    a run reads each source's last fetch up to its time and no other."""
    _, sources = daily_inputs(spark, sf_dir)
    rows = A.events(spark, sf_dir).filter(kind() == "rss")
    shared = F.concat(F.lit("feed "), (F.col("source_ord") % 2).cast("string"))

    def fetch(part, hours):
        fetched = F.make_interval(hours=F.lit(hours))
        return A.feed_payloads(rows.filter(part)).withColumns({
            "source_name": shared, "path": F.lit("http"), "fetched_at": A.as_of() + fetched})

    third = F.col("event_id") % 3
    payloads = fetch(third >= 0, -26).unionByName(fetch(third == 0, -3)).unionByName(fetch(third != 0, 0)).unionByName(
        fetch(third >= 0, 1))
    feeds = sources.filter(kind() == "rss").withColumn("source_name", shared)
    run = collect_items(payloads, feeds, A.as_of())
    return run.items.select("source_ord", F.replace("title", F.lit(" & "), F.lit(" ")).alias("title"))


@query("j1_staggered_pages", f"""
WITH {EVENTS}, pages AS (
  SELECT source_ord, title, row_number() OVER (PARTITION BY source_ord ORDER BY event_id) - 1 AS page_no,
    count(*) OVER (PARTITION BY source_ord) AS n FROM ev WHERE source_type = 'reddit')
SELECT CAST(source_ord AS INT) AS source_ord, page_no, CASE WHEN source_ord % 2 = 0 AND n > 2 THEN title ELSE 'second try' END AS body
FROM pages WHERE source_ord % 2 = 0 AND n > 2 OR page_no % 2 = 0
""")
def j1_staggered_pages(spark, sf_dir):
    """Listings whose pages land one after another. Before the fetch that counts there is an older one, after it a second try that
    lacks pages, and one of its pages was read twice: every page of it comes once. Every other source has no whole fetch,
    so its last one is read."""
    _, sources = daily_inputs(spark, sf_dir)
    rows = A.events(spark, sf_dir).filter(kind() == "reddit")
    page = F.row_number().over(Window.partitionBy("source_ord").orderBy("event_id")) - 1
    pages = rows.select(
        "source_ord", "source_name", "source_type", F.lit("client").alias("path"), page.cast("long").alias("page_no"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("body"),
    )

    def fetch(some, minutes, body=None):
        stamped = pages.filter(some).withColumn("fetched_at", A.as_of() + F.make_interval(mins=F.lit(minutes), secs=F.col("page_no") * 0.05))
        return stamped.withColumn("body", F.lit(body)) if body else stamped

    even = F.col("source_ord") % 2 == 0
    earlier = F.col("fetched_at") - F.expr("interval 1 millisecond")
    payloads = (
        fetch(even | (F.col("page_no") >= 2), -600, "older").unionByName(fetch(even, -300))
        .unionByName(fetch(even & (F.col("page_no") == 3), -300, "read before").withColumn("fetched_at", earlier))
        .unionByName(fetch(F.col("page_no") % 2 == 0, -30, "second try"))
    )
    bound = bind(payloads, sources.filter(kind() == "reddit"), A.as_of())
    return bound.select("source_ord", "page_no", "body")
