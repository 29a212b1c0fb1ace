"""Order-dependent building blocks that never gather one group in one task.

Source order is data: ``(source_ord, page_no, item_pos)``. ``page_no`` counts landed payloads and may grow without
bound; ``item_pos`` is a place inside one payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOTS = 32
PAGES_PER_BLOCK = 1024


def top_per_group(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    limit: Column | int,
    max_limit: int,
    spread: list[str],
    rank: str | None = None,
) -> DataFrame:
    """The first ``limit`` rows of each group. ``limit`` may differ by row; one above ``max_limit`` stops the job.

    ``order`` must be total. Groups are cut twice: first inside slots hashed from ``spread``, then whole. Both cuts
    are by a constant, so Spark also cuts before each shuffle; the second sees at most ``SLOTS * max_limit`` rows of a
    group, however large the group is.
    """
    # Spark cuts groups before a shuffle only up to this bound.
    threshold = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(df.sparkSession.conf.get(threshold)) < max_limit:
        df.sparkSession.conf.set(threshold, str(max_limit))
    bound = F.lit(max_limit)
    if isinstance(limit, int):
        if limit > max_limit:
            raise ValueError(f"a limit is above {max_limit}")
        wanted = F.lit(limit)
    else:
        refused = F.raise_error(F.lit(f"a limit is above {max_limit}")).cast("int")
        wanted = F.when(limit > bound, refused).otherwise(limit)
    name = rank or "_rank"
    slotted = df.withColumn("_slot", F.pmod(F.xxhash64(*spread), F.lit(SLOTS)))
    in_slot = W.partitionBy(*group, "_slot").orderBy(*order)
    in_group = W.partitionBy(*group).orderBy(*order)
    kept = (
        slotted.withColumn("_n", F.row_number().over(in_slot)).filter(F.col("_n") <= bound).drop("_n", "_slot")
        .withColumn(name, F.row_number().over(in_group))
        .filter(F.col(name) <= bound).filter(F.col(name) <= wanted)
    )
    return kept if rank else kept.drop(name)


def running_total(
    df: DataFrame, value: Column, out: str, group: list[str], blocks: dict[str, Column], order: list[str]
) -> DataFrame:
    """Sum of ``value`` over the rows of the group that come before each row.

    ``blocks`` are the leading parts of the order, cut into ranges: totals per block are summed up over the (few)
    blocks, rows only inside their own block, so that a task holds one block and not a whole group. Both halves read
    ``df``; group and block columns must not be null.
    """
    keys = [*group, *blocks]
    rows = df.withColumns({**blocks, "_value": value})
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy(*group).orderBy(*blocks).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = (
        rows.groupBy(*keys).agg(F.sum("_value").alias("_total"))
        .select(*keys, F.coalesce(F.sum("_total").over(before), zero).alias("_before"))
    )
    counted = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), zero))
    return counted.join(offsets, keys).withColumn(out, F.col("_before") + F.col("_inside")).select(*df.columns, out)


def item_blocks() -> dict[str, Column]:
    """Blocks of the item order inside one run."""
    return {
        "_source": F.col("source_ord"),
        "_pages": F.expr(f"page_no div {PAGES_PER_BLOCK}"),
    }


def page_blocks() -> dict[str, Column]:
    """Blocks of the page order inside one source."""
    return {"_pages": F.expr(f"page_no div {PAGES_PER_BLOCK}")}


def joined_text(
    df: DataFrame, text: str, separator: str, group: list[str], blocks: dict[str, Column], order: list[str],
    max_chars: int, keep: dict[str, Column] | None = None,
) -> DataFrame:
    """Texts joined in order, as parts of about ``max_chars`` characters (a part closes with the text that fills it).

    A group below the limit is one part, number 0. The limit is what keeps a part in one task's memory. ``keep`` are
    extra aggregates per part.
    """
    sized = running_total(df, F.length(text).cast("long"), "_start", group, blocks, order)
    numbered = sized.withColumn("part", F.expr(f"_start div {max_chars}"))
    literal = separator.replace("\n", "\\n")
    listed = F.expr(f"listagg({text}, '{literal}') within group (order by {', '.join(order)})")
    extra = [c.alias(n) for n, c in (keep or {}).items()]
    return numbered.groupBy(*group, "part").agg(listed.alias(text), *extra)
