"""S3: JSON listing pages to posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.schemas import LISTING
from tidings.sources.faults import error_rows

# What a post must have to become an item.
REQUIRED = ("id", "title", "author", "url", "created", "score", "num_comments", "over_18")


def children(body: str = "body") -> Column:
    """The children of a landed page; null if the page cannot be read."""
    return F.from_json(F.col(body), LISTING)["data"]["children"]


def readable(body: str = "body") -> Column:
    return F.coalesce(children(body).isNotNull(), F.lit(False))


def read_pages(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per page: its children and its cursor to the next page."""
    kept = [c for c in payloads.columns if c != body]
    page = payloads.select(*kept, F.from_json(F.col(body), LISTING)["data"].alias("p"))
    return page.select(*kept, F.col("p.after").alias("after"), F.col("p.children").alias("children"))


def explode_posts(pages: DataFrame) -> DataFrame:
    """One row per child, in page order (``item_pos``)."""
    kept = [c for c in pages.columns if c != "children"]
    rows = pages.select(*kept, F.posexplode("children").alias("item_pos", "c"))
    return rows.select(*kept, "item_pos", "c.data.*")


def read_listing(payloads: DataFrame, body: str = "body") -> DataFrame:
    """S3: one row per post of every landed page."""
    return explode_posts(read_pages(payloads, body))


def complete(post: Column | None = None) -> Column:
    """Whether a post (of columns, or a struct) has every field a record needs; others go to the error rows, one by one."""
    return reduce(Column.__and__, [(F.col(c) if post is None else post[c]).isNotNull() for c in REQUIRED])


def listing_errors(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Error rows for unreadable pages and for posts with missing fields, from one reading of each page."""
    pages = payloads.select("source_name", F.sha2(F.col(body), 256).alias("body_sha"), children(body).alias("children"))
    bad = F.filter("children", lambda c: ~complete(c["data"]))
    reasons = F.transform(bad, lambda c: F.concat(F.lit("post with missing fields: "), F.coalesce(c["data"]["id"], F.lit("?"))))
    unreadable = F.col("children").isNull()
    return error_rows(pages, "listing", F.when(unreadable, F.array(F.lit("unreadable page"))).otherwise(reasons))
