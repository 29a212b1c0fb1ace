"""A1-A4: counts by type, by source, in all; and what each stage kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def item_counts(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1, A2, A3 in one pass: rows for each type and source, each type (source null), and all (both null).

    ``level`` is 0, 1, 3 for these. With ``by`` (such as ``run_date``) the totals are per group. Rows are counted per
    source first, so only those counts are expanded into the three levels.
    """
    by = by or []
    per_source = items.groupBy(*by, "source_type", "source_name").agg(F.count("*").alias("n"))
    sets = [[*by, "source_type", "source_name"], [*by, "source_type"], by]
    columns = [F.col(c) for c in (*by, "source_type", "source_name")]
    return per_source.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.grouping_id().cast("int").alias("level"), F.coalesce(F.sum("n"), F.lit(0)).alias("items")
    )


def run_totals(sources: DataFrame, items: DataFrame) -> DataFrame:
    """A3: how many sources were configured, how many gave items, how many items came."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    configured = sources.select(one.alias("s"), zero.alias("h"), zero.alias("n"))
    came = items.groupBy("source_ord").agg(F.count("*").alias("n")).select(zero.alias("s"), one.alias("h"), "n")
    return configured.unionByName(came).agg(
        *[F.coalesce(F.sum(c), zero).alias(name)
          for c, name in (("s", "sources"), ("h", "sources_with_items"), ("n", "items"))]
    )


def stage_counts(entries: DataFrame, stages: dict[str, Column], by: tuple[str, ...] = ("source_type", "source_name")):
    """A4: rows read, and rows that pass each stage, per source."""
    passed = [F.count_if(test).alias(name) for name, test in stages.items()]
    return entries.groupBy(*by).agg(F.count("*").alias("read"), *passed)
