"""Which items are recent enough. ``as_of`` is always given, never read from the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.dates import midnight, run_day

SECONDS_PER_DAY = 86400


def in_calendar_days(
    published: Column, as_of: Column, days: Column | int, zone: str = "UTC", most_days: int | None = None
) -> Column:
    """from the midnight ``days`` days back up to (not including) today's midnight.

    An unknown date gives null, which a filter drops. Both bounds are plain comparisons with the stored time, so with
    constant ``days`` and ``as_of`` they reach the scan; where ``days`` differs by row, ``most_days`` adds a constant
    bound that does.
    """
    inside = (published >= midnight(as_of, days, zone)) & (published < midnight(as_of, 0, zone))
    return inside if most_days is None else inside & (published >= midnight(as_of, most_days, zone))


def since_cutoff(published: Column, as_of: Column, days: Column | int) -> Column:
    """at most ``days`` times 24 hours before ``as_of`` in whole seconds, with no upper bound."""
    days = F.lit(days) if isinstance(days, int) else days
    # The cutoff is a whole second, so the stored time itself can be compared with it.
    return published >= F.timestamp_seconds(F.unix_seconds(as_of) - days.cast("long") * SECONDS_PER_DAY)


def is_recent(
    kind: Column, published: Column, as_of: Column, days: Column | int, zone: str = "UTC"
) -> Column:
    """F1-F3 by source type: feeds and videos by calendar day, listings by cutoff (an unknown date stays in),
    scraped articles always."""
    return (
        F.when(kind.isin("rss", "youtube"), in_calendar_days(published, as_of, days, zone))
        .when(kind == "reddit", F.coalesce(since_cutoff(published, as_of, days), F.lit(True)))
        .otherwise(kind == "scrape")
    )


def run_days(items: DataFrame, days: int, published: str = "publish_date", zone: str = "UTC") -> DataFrame:
    """F1 for a backfill: one row per run day whose window holds the item (no join with a calendar needed)."""
    day = run_day(F.col(published), zone)
    if days <= 0:
        return items.withColumn("run_date", day).filter(F.lit(False))
    following = F.sequence(F.date_add(day, 1), F.date_add(day, days))
    return items.filter(F.col(published).isNotNull()).withColumn("run_date", F.explode(following))
