"""Which landed listing pages a run would have read before it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.operators.ordered import page_blocks, running_total, top_per_group

SOURCE = ["run_date", "source_ord"]


def pages_until_enough(pages: DataFrame, valid: str = "valid", cap: str = "max_results") -> DataFrame:
    """Pages whose predecessors hold fewer than ``cap`` valid posts (the page that fills up is kept whole).

    ``pages`` has one narrow row per page. Only the *pages* depend on this rule: the first ``cap`` valid posts of a
    source are the same with or without it, so a run that needs just the posts filters and caps them directly.
    """
    counted = running_total(pages, F.col(valid).cast("long"), "seen", SOURCE, page_blocks(), ["page_no"])
    return counted.filter(F.col("seen") < F.col(cap))


def pages_until_end(
    pages: DataFrame, max_cap: int, size: str = "size", after: str = "after", cap: str = "max_results",
    keep_last_page: bool = True,
) -> DataFrame:
    """Pages read while fewer than ``cap`` posts of any age were seen.

    The scan ends at a page without posts or cursor. Such a page is itself dropped by the original rule
    (``keep_last_page=False``); by default its posts are kept. Every page before the end has a post, so a source can
    use at most ``cap`` pages: the rest is cut before anything is summed up.
    """
    ended = (F.col(size) == 0) | F.col(after).isNull()
    first = top_per_group(pages.withColumn("_ended", ended), SOURCE, [F.col("page_no")], max_cap, max_cap, ["page_no"])
    in_order = W.partitionBy(*SOURCE).orderBy("page_no")
    earlier = in_order.rowsBetween(W.unboundedPreceding, -1)
    marked = first.withColumns({
        "seen": F.coalesce(F.sum(F.col(size).cast("long")).over(earlier), F.lit(0).cast("long")),
        "_over": F.coalesce(F.max("_ended").over(earlier), F.lit(False)),
    })
    read = marked.filter((F.col("seen") < F.col(cap)) & ~F.col("_over"))
    if not keep_last_page:
        read = read.filter(~F.col("_ended"))
    return read.drop("_ended", "_over")
