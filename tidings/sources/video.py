"""Video search results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.dates import iso_zone, iso_zoned
from tidings.schemas import SEARCH
from tidings.sources.faults import error_rows

# What a search result must have to become an item.
REQUIRED = ("video_id", "title", "description", "thumbnail_url")


def read_videos(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per search result, in result order (``item_pos``)."""
    kept = [c for c in payloads.columns if c != body]
    found = payloads.select(*kept, F.from_json(F.col(body), SEARCH)["items"].alias("items"))
    rows = found.select(*kept, F.posexplode("items").alias("item_pos", "v"))
    v = F.col("v")
    published = v["snippet"]["publishedAt"]
    return rows.select(
        *kept, "item_pos",
        v["id"]["videoId"].alias("video_id"),
        v["snippet"]["title"].alias("title"),
        v["snippet"]["description"].alias("description"),
        v["snippet"]["channelId"].alias("video_channel_id"),
        v["snippet"]["channelTitle"].alias("channel_title"),
        v["snippet"]["thumbnails"]["high"]["url"].alias("thumbnail_url"),
        iso_zoned(published).alias("publish_date"),
        iso_zone(published).alias("publish_zone"),
    )


def complete() -> Column:
    """Whether a result has every field a record needs."""
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in REQUIRED])


def video_errors(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Error rows for unreadable searches and for results without the fields a record needs, from one reading of each search."""
    items = F.from_json(F.col(body), SEARCH)["items"].alias("items")
    found = payloads.select("source_name", F.sha2(F.col(body), 256).alias("body_sha"), items)
    whole = F.transform("items", lambda v: F.struct(v["id"]["videoId"].alias("video_id"), (
        v["id"]["videoId"].isNotNull() & v["snippet"]["title"].isNotNull()
        & v["snippet"]["description"].isNotNull() & v["snippet"]["thumbnails"]["high"]["url"].isNotNull()
    ).alias("whole")))
    reasons = F.transform(
        F.filter(whole, lambda v: ~v["whole"]), lambda v: F.concat(F.lit("video with missing fields: "), F.coalesce(v["video_id"], F.lit("?")))
    )
    unreadable = F.col("items").isNull()
    return error_rows(found, "video", F.when(unreadable, F.array(F.lit("unreadable search result"))).otherwise(reasons))
