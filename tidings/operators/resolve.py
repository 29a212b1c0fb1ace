"""Binding payloads to sources, handles to channels, and listings to the path that worked."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.dates import run_day
from tidings.functions.text import is_blank
from tidings.session import broadcast_counted, broadcast_if, through_table

HANDLE_CANDIDATES = 5


FETCH_HOURS = 24

# Pages of one fetch land one after another; a longer pause means another fetch.
SESSION_GAP_MINUTES = 10


def of_run(payloads: DataFrame, as_of: Column | None, hours: int = FETCH_HOURS) -> DataFrame:
    """What a run at ``as_of`` may read: payloads fetched in the ``hours`` up to it. Without ``as_of`` all are read.
    The bounds are constants, so the scan skips the rest of the history."""
    if as_of is None:
        return payloads
    fetched = F.col("fetched_at")
    return payloads.filter((fetched <= as_of) & (fetched > as_of - F.make_dt_interval(hours=F.lit(hours))))


def identity(payloads: DataFrame) -> list[str]:
    """What names the source of a payload: its place in the source list where payloads carry it, else name and type."""
    return ["source_name", "source_type", *(["source_ord"] if "source_ord" in payloads.columns else [])]


def split_namesakes(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where payloads name their source only: the first source of each name and type, and an error row for the others."""
    name = ["source_name", "source_type"]
    first = sources.groupBy(*name).agg(F.min("source_ord").alias("source_ord"))
    others = sources.join(first, [*name, "source_ord"], "left_anti").select(
        "source_name", F.lit("config").alias("stage"), F.lit("another source has this name").alias("reason"),
        F.lit(None).cast("string").alias("body_sha"),
    )
    return sources.join(first, [*name, "source_ord"], "left_semi"), others


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def _slot(gap_minutes: int) -> Column:
    """Ranges of time as wide as the gap: what lies in one can't be apart by more than it."""
    return F.expr(f"unix_micros(fetched_at) div {gap_minutes * 60_000_000}")


def fetch_sessions(slots: DataFrame, keys: list[str], gap_minutes: int | None) -> DataFrame:
    """Which pages were got by one fetch: ``(source, path, slot, began_at, ended_at)``, from the first and the last time of each slot.

    A lander stamps each page when it gets it. Pages of one source and path belong together as long as none is
    ``gap_minutes`` later than the one before; without a gap each slot is a fetch (a ``fetch_id``). Times are summed up per
    slot before they are put in order, so a source's pages are never sorted, only its slots (a few a day).
    """
    if gap_minutes is None:
        return slots.select(*keys, "slot", "began_at", "ended_at")
    in_time = Window.partitionBy(*keys).orderBy("slot")
    apart = F.col("began_at") > F.lag("ended_at").over(in_time) + F.make_dt_interval(mins=F.lit(gap_minutes))
    begins = F.when(F.coalesce(apart, F.lit(True)), F.col("slot"))
    island = Window.partitionBy(*keys, "_island")
    return (
        slots.withColumn("_begins", begins)
        .withColumn("_island", F.last("_begins", ignorenulls=True).over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumns({"began_at": F.min("began_at").over(island), "ended_at": F.max("ended_at").over(island)}).select(*keys, "slot", "began_at", "ended_at")
    )


@dataclass(frozen=True)
class Fetches:
    """The fetches that runs read: one narrow row per fetch and slot, and the copies that a page read twice has too many."""

    chosen: DataFrame
    stale: DataFrame
    keys: list[str]

    def missing_pages(self) -> DataFrame:
        """An error row for each listing fetch that had to be read although pages of it are missing."""
        torn = self.chosen.filter(~F.col("whole") & (F.col("source_type") == "reddit"))
        return torn.select(*self.keys, "source_name", "run_date").distinct().select(
            "source_name", F.lit("landing").alias("stage"), F.lit("pages are missing from the last fetch").alias("reason"),
            F.lit(None).cast("string").alias("body_sha"),
        )


def choose_fetches(payloads: DataFrame, as_of: Column | None = None, zone: str = "UTC", gap_minutes: int = SESSION_GAP_MINUTES) -> Fetches:
    """Of several fetches of one source, path and run day the last whole one, or the last if none is whole.

    A fetch belongs to the run at ``as_of``, or to the day it ended on. It is whole if its pages begin with the first (0 or 1)
    and none is missing, and there are as many as ``page_count`` says where payloads carry that. Of a page that was read twice in a fetch the
    later copy counts. All this reads narrow columns, and tables of one row per fetch and slot are written down.
    """
    keys = [*identity(payloads), "path"]
    counted = ["page_count"] if "page_count" in payloads.columns else []
    slot = F.col("fetch_id") if "fetch_id" in payloads.columns else _slot(gap_minutes)
    # The payloads are scanned once, for one narrow row per page and slot.
    landed = payloads.groupBy(*keys, slot.alias("slot"), "page_no").agg(
        F.max("fetched_at").alias("fetched_at"), F.min("fetched_at").alias("_first"), *[F.max(c).alias(c) for c in counted]
    )
    landed = through_table(landed, "landed")
    slots = landed.groupBy(*keys, "slot").agg(F.min("_first").alias("began_at"), F.max("fetched_at").alias("ended_at"))
    sessions = fetch_sessions(slots, keys, None if "fetch_id" in payloads.columns else gap_minutes)
    sessions = through_table(sessions, "sessions").withColumnsRenamed({k: f"_{k}" for k in [*keys, "slot"]})
    placed = landed.join(broadcast_counted(sessions), _same([*keys, "slot"], [f"_{k}" for k in [*keys, "slot"]])).drop(*[f"_{k}" for k in [*keys, "slot"]])
    pages = placed.groupBy(*keys, "began_at", "ended_at", "page_no").agg(
        F.max("fetched_at").alias("fetched_at"), F.min("_first").alias("_first"), *[F.max(c).alias(c) for c in counted]
    )
    pages = through_table(pages, "fetched-pages")
    first, last, n = F.min("page_no"), F.max("page_no"), F.count("*")
    whole = F.coalesce((first <= 1) & (last - first + 1 == n), F.lit(False))
    if counted:
        whole = whole & F.coalesce(n >= F.max("page_count"), F.lit(True))
    fetches = pages.groupBy(*keys, "began_at", "ended_at").agg(whole.alias("whole")).withColumn("as_of", F.col("ended_at") if as_of is None else as_of)
    fetches = fetches.withColumn("run_date", run_day(F.col("as_of"), zone))
    rank = F.struct("whole", "ended_at")
    best = fetches.groupBy(*keys, "run_date").agg(F.max_by(F.struct("began_at", "ended_at", "whole", "as_of"), rank).alias("b")).select(*keys, "run_date", "b.*")
    names = [f"_{k}" for k in keys]
    best = best.withColumnsRenamed({"began_at": "_began", "ended_at": "_ended"})
    mine = sessions.join(best, _same([*names, "began_at", "ended_at"], [*keys, "_began", "_ended"]))
    chosen = through_table(mine.select(*keys, F.col("_slot").alias("slot"), "run_date", "as_of", "whole"), "fetches")
    stale = through_table(pages.filter("fetched_at > _first").select(*keys, "page_no", "began_at", "ended_at", F.col("fetched_at").alias("kept_at")), "stale")
    return Fetches(chosen, stale, keys)


def bind(
    payloads: DataFrame, sources: DataFrame, as_of: Column | None = None, source_bound: int | None = None,
    zone: str = "UTC", gap_minutes: int = SESSION_GAP_MINUTES, fetches: Fetches | None = None,
) -> DataFrame:
    """Each payload of a run's own fetch with its source's settings.

    Which fetch that is (``choose_fetches``) stands in small tables, so that the bodies are not shuffled to find it. The run's time is
    ``as_of``, or when its fetch ended.
    """
    fetches = fetches or choose_fetches(payloads, as_of, zone, gap_minutes)
    keys = fetches.keys
    slot = F.col("fetch_id") if "fetch_id" in payloads.columns else _slot(gap_minutes)
    chosen = fetches.chosen.drop("whole").withColumnsRenamed({k: f"_{k}" for k in [*keys, "slot"]})
    own = payloads.withColumn("slot", slot).join(broadcast_counted(chosen), _same([*keys, "slot"], [f"_{k}" for k in [*keys, "slot"]]))
    stale = fetches.stale.withColumnsRenamed({c: f"_stale_{c}" for c in fetches.stale.columns})
    old = _same([*keys, "page_no"], [f"_stale_{c}" for c in [*keys, "page_no"]]) & (F.col("fetched_at") < F.col("_stale_kept_at")) & (F.col("fetched_at") >= F.col("_stale_began_at"))
    own = own.join(broadcast_counted(stale), old, "left_anti")
    own = own.drop("slot", "fetched_at", "fetch_id", "page_count", *[f"_{k}" for k in [*keys, "slot"]])
    return own.join(
        broadcast_if(sources.withColumnRenamed("url", "source_url"), source_bound), identity(payloads)
    )


def clean_handle(handle: Column) -> Column:
    return F.regexp_replace(handle, "^@", "")


def resolve_channels(sources: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Video sources with their channel, and an error row for each handle without a candidate.

    A given channel id wins. Else, of the first five candidates, the first whose title is the handle (in any case),
    else the first. A source with neither id nor handle is in neither result (F5: no rows, no error).
    """
    videos = sources.filter("source_type = 'youtube'")
    given = videos.filter(~is_blank(F.col("channel_id")))
    asked = videos.filter(is_blank(F.col("channel_id")) & ~is_blank(F.col("channel_handle")))
    title_fits = F.lower("title") == F.lower(clean_handle(F.col("handle")))
    best = (
        candidates.filter(F.col("rank") <= HANDLE_CANDIDATES)
        .groupBy(F.col("handle").alias("channel_handle"))
        .agg(F.max_by("channel_id", F.struct(title_fits.cast("int"), -F.col("rank"))).alias("_found"))
    )
    looked_up = asked.join(best, "channel_handle", "left")
    found = looked_up.filter("_found is not null").withColumn("channel_id", F.col("_found")).drop("_found")
    errors = looked_up.filter("_found is null").select(
        "source_name", F.lit("channel").alias("stage"),
        F.concat(F.lit("no channel for handle "), F.col("channel_handle")).alias("reason"),
        F.lit(None).cast("string").alias("body_sha"),
    )
    return given.unionByName(found), errors


def listing_paths(payloads: DataFrame, readable: Column) -> DataFrame:
    """Per run and listing source, the path to use: the client's if all its pages can be read, else the direct
    one if all of its pages can, else none (``path`` is null and the source gets a placeholder)."""
    ok = F.coalesce(readable, F.lit(False))
    client, direct = F.col("path") == "client", F.col("path") == "direct"
    seen = payloads.groupBy("run_date", "source_ord").agg(
        F.bool_and(F.when(client, ok)).alias("client_ok"),
        F.bool_and(F.when(direct, ok)).alias("direct_ok"),
    )
    return seen.select(
        "run_date", "source_ord",
        F.when(F.col("client_ok"), "client").when(F.col("direct_ok"), "direct").alias("path"),
    )
