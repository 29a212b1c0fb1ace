"""Items as prompt text, and the preview of what would be sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.functions.text import metadata_text, preview
from tidings.operators.ordered import item_blocks, joined_text, running_total

ORDER = ["source_ord", "page_no", "item_pos"]
EMPTY_REPLY = "No content to summarize."
MAX_PROMPT_CHARS = 2_000_000


def item_block(with_url: bool = True) -> Column:
    """One item as prompt text; the single-item prompt has no url line."""
    url = [F.lit("\nSource Url: "), F.col("url")] if with_url else []
    return F.concat(
        F.lit("Title: "), F.col("title"), F.lit("\nSource: "), F.col("source_name"), *url,
        F.lit("\nContent: "), F.col("content"), F.lit("\nMetadata: "), metadata_text(F.col("metadata")),
    )


def batch_prompts(items: DataFrame, prompt: Column, max_chars: int = MAX_PROMPT_CHARS) -> DataFrame:
    """M1: per run day the prompt, a blank line, and all items in order with blank lines between.

    A day that outgrows ``max_chars`` is split into numbered parts, each with the prompt in front; a smaller day is
    one part.
    """
    rows = items.select("run_date", *ORDER, item_block().alias("_text"))
    parts = joined_text(
        rows, "_text", "\n\n", ["run_date"], item_blocks(), ORDER, max_chars, {"items": F.count("*")}
    )
    return parts.select("run_date", "part", "items", F.concat(prompt, F.lit("\n\n"), F.col("_text")).alias("prompt"))


def merging_prompts(replies: DataFrame, prompt: Column, max_chars: int = MAX_PROMPT_CHARS) -> DataFrame:
    """M1, the next round: for run days of several replies ``(run_date, part, reply)`` the prompt and a blank line before the replies of
    neighbouring parts, joined like items. A prompt holds two replies at least, so every round leaves at most half as many.
    """
    in_order = Window.partitionBy("run_date").orderBy("part")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    placed = replies.select(
        "run_date", "part", "reply", (F.row_number().over(in_order) - 1).alias("_no"),
        F.coalesce(F.sum(F.length("reply") + 2).over(before), F.lit(0)).alias("_start"), F.count("*").over(Window.partitionBy("run_date")).alias("_parts"),
    ).filter("_parts > 1")
    numbered = placed.withColumn("_next", F.least(F.expr(f"_start div {max_chars}"), F.expr("_no div 2")))
    listed = F.expr("listagg(reply, '\\n\\n') within group (order by part)")
    return numbered.groupBy("run_date", F.col("_next").cast("long").alias("part")).agg(F.concat(prompt, F.lit("\n\n"), listed).alias("prompt"))


def single_prompts(items: DataFrame, prompt: Column) -> DataFrame:
    """M2: a prompt for each item by itself."""
    return items.withColumn("prompt", F.concat(prompt, F.lit("\n\n"), item_block(with_url=False)))


def replies_or_empty(run_dates: DataFrame, replies: DataFrame) -> DataFrame:
    """each run day's reply; a day without items says so instead of asking a model."""
    return run_dates.join(replies, "run_date", "left").withColumn(
        "reply", F.coalesce("reply", F.lit(EMPTY_REPLY))
    )


def previews(items: DataFrame) -> DataFrame:
    """K4: what a run without the model shows of each item; numbers go through a run day in item order."""
    numbered = running_total(items, F.lit(1).cast("long"), "_before", ["run_date"], item_blocks(), ORDER)
    return numbered.select(
        "run_date",
        (F.col("_before") + 1).alias("item_no"),
        "title",
        F.col("source_name").alias("source"),
        "url",
        F.try_element_at("metadata", F.lit("score")).alias("score"),
        preview(F.col("content")).alias("content"),
        F.array_join(
            F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"
        ).alias("metadata"),
    )
