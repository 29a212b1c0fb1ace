"""Entries of each kind to the one item record. Entries come complete; others are error rows of their scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.dates import iso_zone, scraped_date
from tidings.functions.text import NO_CONTENT, article_id, is_blank
from tidings.functions.urls import article_url
from tidings.schemas import ITEM_COLUMNS
from tidings.sources.page import first_author

VIDEO_URL = "https://www.youtube.com/watch?v="
LISTING_URL = "https://www.reddit.com/r/"

# Fixed value: the content of the item that stands for a listing nobody could read.
PLACEHOLDER_CONTENT = (
    "Failed to retrieve content. Please check your Reddit API credentials or try again later."
)


def metadata(**values: Column) -> Column:
    """A string map in the given order (the order shows in prompts)."""
    return F.create_map(*[part for k, v in values.items() for part in (F.lit(k), v.cast("string"))])


def _item(df: DataFrame, kind: str, **fields: Column) -> DataFrame:
    fields["source_type"] = F.lit(kind)
    have = {c: F.col(c) for c in ITEM_COLUMNS if c in df.columns}
    have.update(fields)
    return df.select(*[have[c].alias(c) for c in ITEM_COLUMNS])


def feed_items(entries: DataFrame, zone: str = "UTC") -> DataFrame:
    """P1, J4. An empty description does not fall through to the content block; only a missing one does."""
    content = F.coalesce(F.col("description"), F.col("encoded"), F.lit(""))
    return _item(
        entries, "rss",
        id=F.coalesce(F.col("uri"), F.col("link")),
        content=content,
        url=F.col("link"),
        publish_zone=F.lit(zone),
        metadata=metadata(
            feedTitle=F.col("feed_title"),
            feedDescription=F.coalesce(F.col("feed_description"), F.lit("")),
            categories=F.array_join("categories", ", "),
        ),
    )


def post_items(posts: DataFrame, path: str, zone: str = "UTC") -> DataFrame:
    """P2 (``path='client'``): blank text is replaced, times have milliseconds.
    P3 (``path='direct'``): only missing text is replaced, times are whole seconds."""
    if path == "client":
        content = F.when(is_blank(F.col("selftext")), F.lit(NO_CONTENT)).otherwise(F.col("selftext"))
        published = F.timestamp_millis((F.col("created") * 1000).cast("long"))
    elif path == "direct":
        content = F.coalesce(F.col("selftext"), F.lit(NO_CONTENT))
        published = F.timestamp_seconds(F.col("created").cast("long"))
    else:
        raise ValueError(f"unknown path {path!r}")
    return _item(
        posts, "reddit",
        content=content,
        publish_date=published,
        publish_zone=F.lit(zone),
        metadata=metadata(
            subreddit=F.col("subreddit"), score=F.col("score"), commentCount=F.col("num_comments"),
            isNsfw=F.col("over_18"),
        ),
    )


def video_items(videos: DataFrame) -> DataFrame:
    """P4."""
    return _item(
        videos, "youtube",
        id=F.col("video_id"),
        content=F.col("description"),
        url=F.concat(F.lit(VIDEO_URL), F.col("video_id")),
        author=F.col("channel_title"),
        metadata=metadata(channelId=F.col("video_channel_id"), thumbnailUrl=F.col("thumbnail_url")),
    )


def article_items(articles: DataFrame, lenient_dates: bool = False, resolve: str = "append") -> DataFrame:
    """P5, P9-P12. ``item_pos`` is the place after the cap, so it is also the number in the id."""
    dated = F.col("date_text")
    return _item(
        articles, "scrape",
        id=article_id(F.col("source_name"), F.col("item_pos")),
        url=article_url(F.col("href"), F.col("url"), resolve),
        publish_date=scraped_date(dated, lenient_dates),
        publish_zone=F.coalesce(iso_zone(dated), F.lit("UTC")),
        author=first_author(),
        metadata=metadata(sourceUrl=F.col("url")),
    )


def placeholder_items(unreadable: DataFrame, zone: str = "UTC") -> DataFrame:
    """One item for each listing source that could not be read on any path.

    The id is derived, not random, so that a retried task gives the same row.
    """
    key = F.sha2(F.concat_ws("|", "source_name", F.col("as_of").cast("string")), 256)
    return _item(
        unreadable, "reddit",
        id=F.concat(F.lit("fallback-"), key),
        title=F.concat(F.lit("Unable to retrieve content from r/"), F.col("subreddit")),
        content=F.lit(PLACEHOLDER_CONTENT),
        url=F.concat(F.lit(LISTING_URL), F.col("subreddit"), F.lit("/"), F.col("sort_by")),
        publish_date=F.col("as_of"),
        publish_zone=F.lit(zone),
        author=F.lit("system"),
        metadata=metadata(
            subreddit=F.col("subreddit"), error=F.concat(F.lit("API access failed: "), F.col("reason"))
        ),
        page_no=F.lit(0),
        item_pos=F.lit(0),
    )
