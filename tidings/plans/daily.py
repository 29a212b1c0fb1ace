"""The daily run: landed payloads and a source list in; items, errors, counts and digests out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.dates import run_day
from tidings.operators.callouts import RULES
from tidings.operators.enrich import add_transcripts
from tidings.operators.limits import cap_per_source, recent_videos
from tidings.operators.model import Client, call_client_once, one_by_one
from tidings.operators.normalize import article_items, feed_items, placeholder_items, post_items, video_items
from tidings.operators.paging import pages_until_end, pages_until_enough
from tidings.operators.prompt import MAX_PROMPT_CHARS, batch_prompts, merging_prompts
from tidings.operators.publish import digests, index_entries, index_text, read_digests, write_archive, write_digests
from tidings.operators.recency import is_recent, since_cutoff
from tidings.operators.render import digest_bodies, digest_lines
from tidings.operators.resolve import FETCH_HOURS, SESSION_GAP_MINUTES, bind, choose_fetches, identity, listing_paths, of_run, resolve_channels, split_namesakes
from tidings.operators.union import union_errors, union_items
from tidings.session import broadcast_counted, broadcast_if, through_table
from tidings.sources import feed, listing, video
from tidings.sources.config import config_facts, split_sources
from tidings.sources.feed import feed_errors, read_feeds
from tidings.sources.listing import explode_posts, listing_errors, read_pages
from tidings.sources.page import page_errors, read_articles
from tidings.sources.video import read_videos, video_errors


@dataclass(frozen=True)
class Run:
    """What a run gives. ``faults`` builds the error rows, which read the payloads once more."""

    items: DataFrame
    faults: Callable[[], DataFrame]

    @property
    def errors(self) -> DataFrame:
        return self.faults()


@dataclass(frozen=True)
class Options:
    zone: str = "UTC"
    keep_last_page: bool = True
    lenient_dates: bool = False
    resolve: str = "append"
    fetch_hours: int = FETCH_HOURS
    session_gap_minutes: int = SESSION_GAP_MINUTES


def collect_items(
    payloads: DataFrame,
    sources: DataFrame,
    as_of: Column | None = None,
    candidates: DataFrame | None = None,
    transcripts: DataFrame | None = None,
    options: Options = Options(),
) -> Run:
    """All items of a run (or of many: without ``as_of`` each payload belongs to the day it was fetched).

    A run reads the last whole fetch of each source and path, of those of the ``fetch_hours`` up to ``as_of``.
    """
    facts = config_facts(sources)
    valid, config_errors = split_sources(sources)
    namesakes = None
    if "source_ord" not in payloads.columns:
        valid, namesakes = split_namesakes(valid)
    payloads = of_run(payloads, as_of, options.fetch_hours)
    fetches = choose_fetches(payloads, as_of, options.zone, options.session_gap_minutes)
    bound = bind(payloads, valid, as_of, facts.sources, options.zone, options.session_gap_minutes, fetches)
    by_type = {kind: bound.filter(F.col("source_type") == kind) for kind in ("rss", "reddit", "youtube", "scrape")}

    channel_errors = None
    if candidates is not None:
        resolved, channel_errors = resolve_channels(valid, candidates)
        # At most one row per source.
        known = broadcast_if(resolved.select("source_ord"), facts.sources)
        by_type["youtube"] = by_type["youtube"].join(known, "source_ord", "left_semi")

    videos = _videos(by_type["youtube"], facts.max_cap, options)
    if transcripts is not None:
        videos = add_transcripts(videos, transcripts)
    items = union_items(
        _feeds(by_type["rss"], facts.max_cap, options),
        _posts(by_type["reddit"], facts.max_cap, options, _expected(valid, as_of, options)),
        videos,
        _articles(by_type["scrape"], facts.max_cap, options),
    )

    def faults() -> DataFrame:
        found = [] if as_of is None else [_not_landed(valid, payloads)]
        found += [fetches.missing_pages(), config_errors, feed_errors(by_type["rss"]), listing_errors(by_type["reddit"]),
                 video_errors(by_type["youtube"]), page_errors(by_type["scrape"])]
        return union_errors(*found, *[e for e in (namesakes, channel_errors) if e is not None])

    return Run(items, faults)


@dataclass(frozen=True)
class Published:
    """Where a run's tables are; without a model there are no digests."""

    archive: str
    digests: str | None
    index: str | None


def day_digests(
    items: DataFrame, prompt: Column, connect: Callable[[], Client], max_chars: int = MAX_PROMPT_CHARS, **settings,
) -> DataFrame:
    """M1, M3: ``(run_date, body, status)``, one row per run day however many items it has.

    The items of a day that outgrows one prompt are asked about in parts; the replies to these become the input of further
    prompts, round by round, until one is left. Each round is a table. A day with a failed part stops there: its body is the first failure.
    """
    asked = batch_prompts(items, prompt, max_chars).select("run_date", "part", "prompt")
    done = []
    while True:
        replies = call_client_once(asked, "prompt", connect, **settings)
        days = replies.groupBy("run_date").agg(
            F.count("*").alias("parts"), F.min_by("status", F.struct(F.col("status") != "failed", "part")).alias("day_status"),
            F.min_by("reply", F.struct(F.col("status") != "failed", "part")).alias("body"),
        )
        days = through_table(days, "day-replies")
        ended = F.expr("parts = 1 or day_status = 'failed'")
        done.append(days.filter(ended).select("run_date", "body", F.col("day_status").alias("status")))
        going = days.filter(~ended)
        if going.isEmpty():
            return reduce(DataFrame.unionByName, done)
        left = replies.join(going.select("run_date"), "run_date", "left_semi").select("run_date", "part", "reply")
        asked = merging_prompts(left, prompt, max_chars)


def publish_run(
    items: DataFrame, output: str, prompt: Column | None = None, complete: Callable[[str], str | None] | None = None,
    generated_at: Column | None = None, max_chars: int = MAX_PROMPT_CHARS, calls_at_once: int | None = None,
    connect: Callable[[], Client] | None = None,
) -> Published:
    """M5: archive the items; then, unless there is neither ``complete`` nor ``connect``, have each run day summarized and published.

    ``complete`` is a model of single texts, ``connect`` the factory of a client that takes batches. Everything after the
    archive reads one table of items, so payloads are scanned once. A day without items is neither
    archived nor summarized (F7). Previews (K4) of a run without a model come from the same archive.
    """
    spark = items.sparkSession
    archive = f"{output.rstrip('/')}/archive"
    items = through_table(items, "items")
    write_archive(items, archive)
    if complete is None and connect is None:
        return Published(archive, None, None)
    if prompt is None or generated_at is None:
        raise ValueError("a summarizing run needs a prompt and the time it is generated at")
    digest_path, index_path = f"{output.rstrip('/')}/digests", f"{output.rstrip('/')}/index"
    settings = {"partitions": calls_at_once} | ({} if connect else {"batch_requests": 1, "attempts": 1})
    replies = day_digests(items, prompt, connect or one_by_one(complete), max_chars, **settings)
    write_digests(digests(replies.select("run_date", "body"), generated_at), digest_path)
    # The index is made from the digest table, so every published day is in it exactly once.
    index_text(index_entries(read_digests(spark, digest_path))).write.mode("overwrite").text(index_path)
    return Published(archive, digest_path, index_path)


def publish_without_model(items: DataFrame, output: str, generated_at: Column, rules=RULES) -> str:
    """The digest the prompt asks for, made by rules instead of a model (R1-R9), in the digest table."""
    items = through_table(items, "items")
    path = f"{output.rstrip('/')}/digests"
    write_digests(digests(digest_bodies(digest_lines(items, rules)), generated_at), path)
    return path


def _recent(entries: DataFrame, options: Options) -> DataFrame:
    return entries.filter(
        is_recent(F.col("source_type"), F.col("publish_date"), F.col("as_of"), F.col("time_range_days"), options.zone)
    )


def _feeds(bound: DataFrame, max_cap: int, options: Options) -> DataFrame:
    # Incomplete entries are error rows; they must not take up a place under the cap.
    entries = _recent(read_feeds(bound).filter(feed.complete()), options)
    return feed_items(cap_per_source(entries, max_cap), options.zone)


def _expected(sources: DataFrame, as_of: Column | None, options: Options) -> DataFrame | None:
    """The listing sources a run at one time must have heard of; a backfill knows only what has landed."""
    if as_of is None:
        return None
    listings = sources.filter("source_type = 'reddit'")
    return listings.withColumn("as_of", as_of).withColumn("run_date", run_day(F.col("as_of"), options.zone))


def _not_landed(sources: DataFrame, payloads: DataFrame) -> DataFrame:
    """An error row for each source that must be fetched and of which nothing has landed."""
    landed = payloads.select(*identity(payloads)).distinct()
    missing = sources.filter(F.col("source_type") != "youtube").join(landed, identity(payloads), "left_anti")
    return missing.select(
        "source_name", F.lit("landing").alias("stage"), F.lit("no payload landed").alias("reason"),
        F.lit(None).cast("string").alias("body_sha"),
    )


def _posts(bound: DataFrame, max_cap: int, options: Options, expected: DataFrame | None) -> DataFrame:
    """J5 picks the path; on the direct one L4b picks the pages; then cutoff and cap; then what nobody could read.

    Every page is decoded once, into a table; the choices read its narrow columns only. A path is judged by the pages
    that a run would have read: up to the first that cannot be read, and none after the one that fills it up.
    """
    def fresh(child: Column) -> Column:
        created = F.timestamp_seconds(child["data"]["created"].cast("long"))
        whole = reduce(Column.__and__, [child["data"][c].isNotNull() for c in listing.REQUIRED])
        return whole & since_cutoff(created, F.col("as_of"), F.col("time_range_days"))

    pages = through_table(
        read_pages(bound).withColumns({
            "readable": F.col("children").isNotNull(),
            "size": F.coalesce(F.size("children"), F.lit(0)),
            "valid": F.coalesce(F.size(F.filter("children", fresh)), F.lit(0)),
        }),
        "pages",
    )
    narrow = pages.select(
        "run_date", "source_ord", "path", "page_no", "max_results", "after", "size", "valid", "readable"
    )
    tried_client = pages_until_enough(narrow.filter("path = 'client'"))
    tried_direct = pages_until_end(narrow.filter("path = 'direct'"), max_cap)
    judged = tried_client.select(*narrow.columns).unionByName(tried_direct.select(*narrow.columns))
    chosen = through_table(listing_paths(judged, F.col("readable")), "paths")
    keys = ["run_date", "source_ord", "path"]
    on_path = pages.join(broadcast_counted(chosen.filter("path is not null")), keys, "left_semi")

    def recent(posts: DataFrame) -> DataFrame:
        created = F.timestamp_seconds(F.col("created").cast("long"))
        fresh = posts.filter(listing.complete()).filter(
            since_cutoff(created, F.col("as_of"), F.col("time_range_days"))
        )
        return cap_per_source(fresh, max_cap)

    # The first max_results recent posts lie on the pages L4a keeps, so the client path needs no page rule.
    client = post_items(recent(explode_posts(on_path.filter("path = 'client'"))), "client", options.zone)

    direct_pages = on_path.filter("path = 'direct'")
    sizes = direct_pages.select("run_date", "source_ord", "page_no", "max_results", "after", "size")
    kept = pages_until_end(sizes, max_cap, keep_last_page=options.keep_last_page)
    read = through_table(kept.select("run_date", "source_ord", "page_no"), "pages-read")
    on_pages = direct_pages.join(broadcast_counted(read), ["run_date", "source_ord", "page_no"], "left_semi")
    direct = post_items(recent(explode_posts(on_pages)), "direct", options.zone)

    about = ["source_name", "subreddit", "sort_by", "as_of"]
    if expected is None:
        expected = pages.groupBy("run_date", "source_ord").agg(*[F.min(c).alias(c) for c in about])
    tried = chosen.withColumn("landed", F.lit(True))
    unread = expected.join(tried, ["run_date", "source_ord"], "left").filter("path is null").select(
        "run_date", "source_ord", *about,
        F.when(F.col("landed"), "unreadable listing").otherwise("no payload landed").alias("reason"),
    )
    return union_items(client, direct, placeholder_items(unread, options.zone))


def _videos(bound: DataFrame, max_cap: int, options: Options) -> DataFrame:
    return video_items(recent_videos(read_videos(bound).filter(video.complete()), max_cap, zone=options.zone))


def _articles(bound: DataFrame, max_cap: int, options: Options) -> DataFrame:
    keep = ["source_name", "source_ord", "page_no", "run_date", "as_of", "max_results", "selectors", "body"]
    articles = read_articles(bound.select(*keep, F.col("source_url").alias("url")))
    return article_items(cap_per_source(articles, max_cap), options.lenient_dates, options.resolve)
