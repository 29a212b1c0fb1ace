"""Caps and listing orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.operators.ordered import top_per_group
from tidings.operators.recency import in_calendar_days

OVERFETCH_FACTOR = 2
OVERFETCH_LEAST = 50


def source_order() -> list[Column]:
    return [F.col("page_no"), F.col("item_pos")]


def cap_per_source(
    items: DataFrame, max_cap: int, cap: Column | int | str = "max_results", group: tuple[str, ...] = ("run_date", "source_ord")
) -> DataFrame:
    """L1, L2: the first items of each source in source order (not by date), each source up to its own cap."""
    limit = F.col(cap) if isinstance(cap, str) else cap
    return top_per_group(items, list(group), source_order(), limit, max_cap, ["page_no", "item_pos"])


def overfetch(cap: Column | int) -> Column:
    """L3: how many of the newest videos are looked at."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    return F.greatest(cap * OVERFETCH_FACTOR, F.lit(OVERFETCH_LEAST))


def recent_videos(
    videos: DataFrame, max_cap: int, cap: str = "max_results", days: str = "time_range_days", zone: str = "UTC",
    group: tuple[str, ...] = ("run_date", "source_ord"),
) -> DataFrame:
    """L3: the newest ``overfetch`` results, of these the recent ones (F1), of these the first ``cap``.

    Results land newest first; ties and unknown dates keep landed order.
    """
    newest_first = [F.col("publish_date").desc_nulls_last(), F.col("page_no"), F.col("item_pos")]
    seen = top_per_group(
        videos, list(group), newest_first, overfetch(F.col(cap)),
        max(OVERFETCH_FACTOR * max_cap, OVERFETCH_LEAST), ["page_no", "item_pos"],
    )
    recent = seen.filter(in_calendar_days(F.col("publish_date"), F.col("as_of"), F.col(days), zone))
    return top_per_group(recent, list(group), newest_first, F.col(cap), max_cap, ["page_no", "item_pos"])


def listing_order(sort_by: str, created: str = "publish_date", score: str = "score") -> list[Column]:
    """The order of a landed listing: newest or best first; the other orders are known only as landed."""
    if sort_by == "new":
        return [F.col(created).desc_nulls_last(), *source_order()]
    if sort_by == "top":
        return [F.col(score).desc_nulls_last(), *source_order()]
    return source_order()


def newest_first(digests: DataFrame) -> DataFrame:
    """Digests by day, latest on top."""
    return digests.orderBy(F.col("run_date").desc())
