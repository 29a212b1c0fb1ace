"""RSS (1.0 and 2.0) and Atom payloads to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.dates import feed_date
from tidings.schemas import ATOM, RSS
from tidings.sources.faults import error_rows

# Bodies that are no feed become error rows; the job goes on.
XML = {"mode": "PERMISSIVE", "ignoreNamespace": "true"}

# The root element tells the dialect; it may stand behind a declaration, comments and a document type.
BEFORE_ROOT = r"(?s)^[\s\x{feff}]*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<(?:[\w.-]+:)?"
ATOM_ROOT = BEFORE_ROOT + r"feed[\s>/]"
RSS_ROOT = BEFORE_ROOT + r"(?:rss|RDF)[\s>/]"


def is_atom(body: str = "body") -> Column:
    return F.coalesce(F.col(body).rlike(ATOM_ROOT), F.lit(False))


def is_rss(body: str = "body") -> Column:
    return F.coalesce(F.col(body).rlike(RSS_ROOT), F.lit(False))


def read_feeds(payloads: DataFrame, body: str = "body") -> DataFrame:
    """One row per entry, in feed order (``item_pos``). Reads all dialects in one pass; other roots have no entries."""
    kept = [c for c in payloads.columns if c != body]
    rows = _parsed(payloads, kept, body).select(*kept, "feed_title", "feed_description", F.posexplode("entries").alias("item_pos", "e"))
    return rows.select(*kept, "item_pos", "feed_title", "feed_description", "e.*")


def _parsed(payloads: DataFrame, kept: list, body: str) -> DataFrame:
    """Each payload parsed once: its title, description and entries, all null if it is no feed. Items and errors are read from this."""
    feeds = payloads.select(
        *kept,
        F.when(is_rss(body), F.from_xml(F.col(body), RSS, XML)).alias("rss"),
        F.when(is_atom(body), F.from_xml(F.col(body), ATOM, XML)).alias("atom"),
    )
    names = [c for c in feeds.columns if c not in ("rss", "atom")]
    return feeds.select(
        *names,
        F.coalesce(F.col("rss.channel.title"), F.col("atom.title")).alias("feed_title"),
        F.coalesce(F.col("rss.channel.description"), F.col("atom.subtitle")).alias("feed_description"),
        F.coalesce(
            F.transform(F.coalesce("rss.channel.item", "rss.item"), _rss_entry), F.transform("atom.entry", _atom_entry)
        ).alias("entries"),
    )


def _entry(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _rss_entry(e: Column) -> Column:
    guid = e["guid"]["_VALUE"]
    is_link = F.coalesce(F.lower(e["guid"]["_isPermaLink"]), F.lit("true")) == "true"
    return _entry(
        uri=F.coalesce(guid, e["_about"]),
        link=F.coalesce(e["link"], F.when(is_link, guid)),
        title=e["title"],
        description=e["description"],
        encoded=e["encoded"],
        # Parsed as part of the entry, so that a filter on the date does not parse it again.
        publish_date=feed_date(F.coalesce(e["pubDate"], e["date"])),
        author=F.coalesce(e["creator"], e["author"], F.lit("")),
        categories=F.coalesce(e["category"], e["subject"], F.array().cast("array<string>")),
    )


def _atom_entry(e: Column) -> Column:
    links = e["link"]
    alternate = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    categories = F.coalesce(e["category"], F.array().cast("array<struct<_term:string>>"))
    return _entry(
        uri=e["id"],
        link=F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"]),
        title=e["title"],
        description=e["summary"],
        encoded=e["content"],
        publish_date=feed_date(e["published"]),
        author=F.coalesce(F.get(e["author"], F.lit(0))["name"], F.lit("")),
        categories=F.transform(categories, lambda c: c["_term"]),
    )


def complete() -> Column:
    """Whether an entry has every field a record needs."""
    return F.col("feed_title").isNotNull() & F.col("title").isNotNull() & F.col("link").isNotNull()


def feed_errors(payloads: DataFrame, body: str = "body") -> DataFrame:
    """An error row for each payload that is no feed, and for each entry without title or link."""
    feeds = _parsed(payloads, ["source_name", F.sha2(F.col(body), 256).alias("body_sha")], body)
    bad = F.filter("entries", lambda e: e["title"].isNull() | e["link"].isNull())
    reasons = F.transform(bad, lambda e: F.concat(F.lit("entry without title or link: "), F.coalesce(e["uri"], e["link"], F.lit("?"))))
    unreadable = F.col("feed_title").isNull()
    return error_rows(feeds, "feed", F.when(unreadable, F.array(F.lit("unreadable feed"))).otherwise(reasons))
