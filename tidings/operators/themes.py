"""The words that mark a run day, and the sentences that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import strip_tags, words
from tidings.operators.enrich import basis
from tidings.operators.ordered import top_per_group
from tidings.session import broadcast_days

THEMES = 10
SENTENCES = 5
SENTENCE_WORDS = 5
SENTENCE_END = r"[.!?]+\s+|\n+"


def theme_text() -> Column:
    return strip_tags(F.concat_ws(" ", F.col("title"), basis()))


def word_counts(items: DataFrame, by: str = "run_date") -> DataFrame:
    """Occurrences (``tf``) and items (``df``) of each word: one explode, one aggregation combined before the shuffle."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    listed = items.select(by, words(theme_text()).alias("w"))
    each = F.transform("w", lambda t: F.struct(t.alias("word"), one.alias("tf"), zero.alias("df")))
    once = F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("word"), zero.alias("tf"), one.alias("df")))
    rows = listed.select(by, F.inline(F.concat(each, once)))
    return rows.groupBy(by, "word").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def themes(items: DataFrame, k: int = THEMES, by: str = "run_date") -> DataFrame:
    """The ``k`` words of greatest ``tf * ln((1 + N) / (1 + df))`` per day, ties by word."""
    sizes = items.groupBy(by).agg(F.count("*").alias("n"))
    weight = F.round(F.col("tf") * F.log((1 + F.col("n")) / (1 + F.col("df"))), 6)
    weighted = word_counts(items, by).join(broadcast_days(sizes, by), by).withColumn("weight", weight).drop("n")
    return top_per_group(
        weighted, [by], [F.col("weight").desc(), F.col("word")], k, k, ["word"], rank="rank"
    )


def overview(
    items: DataFrame, marked: DataFrame, limit: int = SENTENCES, least_words: int = SENTENCE_WORDS,
    by: str = "run_date",
) -> DataFrame:
    """The sentences of greatest mean theme weight per day (other words weigh 0; at least ``least_words`` words).

    Equal sentences count once. ``marked`` has at most ``k`` words per day, so it travels as one small map per day.
    """
    # At most k entries a day by construction, whatever the size of the input.
    weights = marked.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("word", "weight"))).alias("weights"))
    # Words are taken while the text is cut: as a later column they would be taken again by the filter.
    cut = F.transform(
        F.split(theme_text(), SENTENCE_END),
        lambda s: F.struct(F.trim(F.regexp_replace(s, r"\s+", " ")).alias("sentence"), words(s).alias("w")),
    )
    sentences = items.select(by, F.inline(cut)).filter(F.size("w") >= least_words)
    total = F.aggregate(
        "w", F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at("weights", t), F.lit(0.0))
    )
    scored = (
        sentences.join(broadcast_days(weights, by), by).withColumn("score", F.round(total / F.size("w"), 6))
        .filter("score > 0").select(by, "sentence", "score").distinct()
    )
    order = [F.col("score").desc(), F.col("sentence")]
    return top_per_group(scored, [by], order, limit, limit, ["sentence"], rank="rank")
