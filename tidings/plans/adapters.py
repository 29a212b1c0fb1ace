"""Plain tables as inputs: event rows become items and landed payloads, documents and threads become items.

Sizes per group are bounded by construction: a payload holds the events of one id range, never a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.session import spread

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"

AS_OF = "2024-01-15 12:00:00"
LATE_AS_OF = "2024-01-30 12:00:00"
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
TYPE_OF = {"click": "rss", "error": "rss", "purchase": "reddit", "signup": "scrape", "view": "youtube"}
DAYS_OF = {"rss": 3, "reddit": 2, "youtube": 5, "scrape": 1}
CAP_OF = {"rss": 20, "reddit": 50, "youtube": 10, "scrape": 30}
MAX_CAP = 50
SOURCES_PER_TYPE = 5
ITEMS_PER_PAGE = 1000


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts, which are costly per row: all cores get a share also of a single small file."""
    return spread(table(spark, sf_dir, name))


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def by_value(key: Column, values: dict) -> Column:
    """The value for each key, null for others: one small constant map, however often the column is used again."""
    return F.try_element_at(F.create_map(*[F.lit(part) for pair in values.items() for part in pair]), key)


def ts_text(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the source each belongs to."""
    raw = table(spark, sf_dir, "events", EVENTS)
    order = by_value(F.col("event_type"), {t: i * SOURCES_PER_TYPE for i, t in enumerate(EVENT_TYPES)})
    slot = F.col("user_id") % SOURCES_PER_TYPE
    return raw.withColumns({
        "source_type": by_value(F.col("event_type"), TYPE_OF),
        "source_name": F.concat("event_type", F.lit("-"), slot.cast("string")),
        "source_ord": (order + slot).cast("int"),
    })


def with_settings(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "time_range_days": by_value(F.col("source_type"), DAYS_OF),
        "max_results": by_value(F.col("source_type"), CAP_OF),
    })


def event_items(spark: SparkSession, sf_dir: str, run: str = AS_OF) -> DataFrame:
    """Each event as an item; settings of its source are kept as columns."""
    rows = with_settings(events(spark, sf_dir))
    return rows.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("title"),
        F.col("props").alias("content"),
        F.concat(F.lit("https://example.org/e/"), F.col("event_id").cast("string")).alias("url"),
        F.col("ts").alias("publish_date"),
        F.lit("UTC").alias("publish_zone"),
        F.col("user_id").cast("string").alias("author"),
        "source_type", "source_name",
        F.create_map(
            F.lit("score"), F.floor("value").cast("string"), F.lit("kind"), F.col("event_type")
        ).alias("metadata"),
        F.to_date(as_of(run)).alias("run_date"),
        as_of(run).alias("as_of"),
        "source_ord",
        F.expr(f"event_id div {ITEMS_PER_PAGE}").alias("page_no"),
        (F.col("event_id") % ITEMS_PER_PAGE).cast("int").alias("item_pos"),
        "time_range_days", "max_results",
    )


def daily_items(items: DataFrame) -> DataFrame:
    """Items with the day after their own as run day."""
    run = F.date_add(F.to_date("publish_date"), 1)
    return items.withColumn("run_date", run).withColumn("as_of", run.cast("timestamp"))


def _payloads(rows: DataFrame, per_page: int, body: Column, entry: Column, **extra: Column) -> DataFrame:
    """Payloads of at most ``per_page`` entries, in event order."""
    keys = ["source_name", "source_type", "source_ord"]
    grouped = rows.withColumn("page_no", F.expr(f"event_id div {per_page}")).groupBy(*keys, "page_no").agg(
        F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))).alias("rows"),
        *[c.alias(n) for n, c in extra.items()],
    )
    entries = F.transform("rows", lambda r: r["e"])
    # The line end keeps the optimizer from taking writing and reading JSON together as nothing to do.
    return grouped.withColumn("entries", entries).select(*keys, "page_no", F.concat(body, F.lit("\n")).alias("body"))


LISTING_PAGE = 125
# Event ids whose page has no cursor, so that a scan ends in mid-table.
LAST_PAGE_EVERY = 17


def post_struct() -> Column:
    """One listing child; texts are missing, empty or blank for some."""
    rest = F.col("event_id") % 5
    selftext = (
        F.when(rest == 1, "").when(rest == 2, "  ").when(rest != 0, F.col("props"))
    )
    post = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("title"),
        F.col("user_id").cast("string").alias("author"),
        F.concat(F.lit("https://example.org/e/"), F.col("event_id").cast("string")).alias("url"),
        selftext.alias("selftext"),
        (F.unix_micros("ts") / 1000000).alias("created"),
        F.floor("value").cast("int").alias("score"),
        (F.col("event_id") % 40).cast("int").alias("num_comments"),
        (F.col("event_id") % 9 == 0).alias("over_18"),
    )
    return F.struct(F.lit("t3").alias("kind"), post.alias("data"))


def listing_payloads(rows: DataFrame) -> DataFrame:
    after = F.when(F.col("page_no") % LAST_PAGE_EVERY != LAST_PAGE_EVERY - 1, F.concat(
        F.lit("t3_"), F.col("page_no").cast("string")))
    body = F.to_json(F.struct(F.lit("Listing").alias("kind"), F.struct(
        after.alias("after"), F.col("entries").alias("children")).alias("data")))
    return _payloads(rows, LISTING_PAGE, body, post_struct())


FEED_PAGE = 500


def _tag(name: str, text: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>")), F.lit(""))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def feed_payloads(rows: DataFrame) -> DataFrame:
    """RSS bodies; guid, description and categories are missing or empty for some entries."""
    eid = F.col("event_id")
    name = eid.cast("string")
    item = F.concat(
        F.lit("<item>"),
        _tag("title", F.concat("event_type", F.lit(" &amp; "), name)),
        _tag("link", F.concat(F.lit("https://example.org/e/"), name)),
        F.when(eid % 3 != 0, F.concat(F.lit('<guid isPermaLink="false">g'), name, F.lit("</guid>"))).otherwise(""),
        _tag("pubDate", F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))),
        _tag("dc:creator", F.when(eid % 4 != 0, F.col("user_id").cast("string"))),
        F.when(eid % 2 == 0, _tag("category", F.col("event_type"))).otherwise(""),
        F.when(eid % 6 == 0, F.lit('<category domain="d">even</category>')).otherwise(""),
        F.when(eid % 5 == 1, F.lit("<description></description>")).when(eid % 5 > 1, _tag("description", _escaped(F.col("props")))).otherwise(""),
        F.concat(F.lit("<content:encoded><![CDATA["), F.col("props"), F.lit("]]></content:encoded>")),
        F.lit("</item>"),
    )
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" '
              'xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'),
        _tag("title", F.concat(F.lit("Feed of "), F.col("source_name"))),
        F.when(F.col("source_ord") % 2 == 0, F.lit("<description>even feed</description>")).otherwise(""),
        F.array_join("entries", ""),
        F.lit("</channel></rss>"),
    )
    return _payloads(rows, FEED_PAGE, body, item)


def atom_payloads(rows: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    name = eid.cast("string")
    entry = F.concat(
        F.lit("<entry>"),
        _tag("id", F.concat(F.lit("urn:e:"), name)),
        _tag("title", F.concat("event_type", F.lit(" "), name)),
        F.concat(F.lit('<link rel="self" href="https://example.org/self/'), name, F.lit('"/>')),
        F.concat(F.lit('<link rel="alternate" href="https://example.org/e/'), name, F.lit('"/>')),
        _tag("published", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(eid % 4 != 0, F.concat(F.lit("<author><name>"), F.col("user_id").cast("string"), F.lit("</name></author>"))).otherwise(""),
        F.concat(F.lit('<category term="'), F.col("event_type"), F.lit('"/>')),
        F.when(eid % 5 != 0, _tag("summary", _escaped(F.col("props")))).otherwise(""),
        _tag("content", F.lit("body")),
        F.lit("</entry>"),
    )
    body = F.concat(
        F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">'),
        _tag("title", F.concat(F.lit("Feed of "), F.col("source_name"))),
        F.lit("<subtitle>atom</subtitle>"),
        F.array_join("entries", ""),
        F.lit("</feed>"),
    )
    return _payloads(rows, FEED_PAGE, body, entry)


SEARCH_PAGE = 1000


def search_payloads(rows: DataFrame) -> DataFrame:
    """Video searches; every 50th result has no readable date."""
    eid = F.col("event_id")
    name = eid.cast("string")
    published = F.when(eid % 50 == 7, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    video = F.struct(
        F.struct(F.concat(F.lit("v"), name).alias("videoId")).alias("id"),
        F.struct(
            F.concat("event_type", F.lit(" "), name).alias("title"),
            F.col("props").alias("description"),
            published.alias("publishedAt"),
            F.concat(F.lit("c"), F.col("source_ord").cast("string")).alias("channelId"),
            F.col("source_name").alias("channelTitle"),
            F.struct(F.struct(F.concat(F.lit("https://example.org/t/"), name).alias("url")).alias("high")).alias("thumbnails"),
        ).alias("snippet"),
    )
    return _payloads(rows, SEARCH_PAGE, F.to_json(F.struct(F.col("entries").alias("items"))), video)


def bound(payloads: DataFrame, run: str = AS_OF) -> DataFrame:
    """Payloads with the run and the settings of their source, as binding them to a source list gives."""
    return with_settings(payloads).withColumns({
        "run_date": F.to_date(as_of(run)),
        "as_of": as_of(run),
        "subreddit": F.col("source_name"),
        "sort_by": F.lit("new"),
    })


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as an item of its source; the first line is the title."""
    doc = F.col("doc_id")
    name = doc.cast("string")
    day = F.date_add(F.lit("2024-03-01").cast("date"), (doc % 10).cast("int"))
    kind = F.element_at(F.array(*[F.lit(t) for t in ("rss", "reddit", "youtube", "scrape")]), (doc % 4).cast("int") + 1)
    scored = F.when(doc % 4 == 1, F.create_map(F.lit("score"), (doc % 100).cast("string"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    return texts(spark, sf_dir, "documents").select(
        name.alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://docs.example.org/"), name).alias("url"),
        day.cast("timestamp").alias("publish_date"),
        F.lit("UTC").alias("publish_zone"),
        F.lit(None).cast("string").alias("author"),
        kind.alias("source_type"),
        F.col("source").alias("source_name"),
        scored.alias("metadata"),
        F.date_add(day, 1).alias("run_date"),
        F.date_add(day, 1).cast("timestamp").alias("as_of"),
        F.expr("cast(substring(source, 4) as int)").alias("source_ord"),
        F.expr(f"doc_id div {ITEMS_PER_PAGE}").alias("page_no"),
        (doc % ITEMS_PER_PAGE).cast("int").alias("item_pos"),
    )


def thread_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a post: its first turn, with the number of replies."""
    turns = table(spark, sf_dir, "conversations")
    threads = turns.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("text"), (F.count("*") - 1).alias("replies")
    )
    return threads.select(
        F.col("conv_id").cast("string").alias("id"),
        F.col("text").alias("selftext"),
        F.col("replies").alias("num_comments"),
    )


def page_payloads(spark: SparkSession, sf_dir: str, selectors: dict[str, str | None], max_results: int) -> DataFrame:
    """Each web page as a scraped source with the given selectors."""
    chosen = F.struct(*[F.lit(selectors.get(s)).cast("string").alias(s) for s in ("articles", "title", "content", "date")])
    return texts(spark, sf_dir, "pages").select(
        F.concat(F.lit("Site "), F.col("page_id").cast("string")).alias("source_name"),
        F.col("page_id").alias("source_ord"),
        F.lit(0).cast("long").alias("page_no"),
        F.to_date(as_of()).alias("run_date"),
        as_of().alias("as_of"),
        "url",
        F.lit(max_results).alias("max_results"),
        chosen.alias("selectors"),
        F.col("html").alias("body"),
    )
