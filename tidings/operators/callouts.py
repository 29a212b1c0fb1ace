"""Which items announce a product, report research or advertise an offer."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import strip_tags
from tidings.operators.enrich import basis

CATEGORIES = ("product", "research", "promo")


class Rule(NamedTuple):
    category: str
    pattern: str
    weight: float = 1.0


# The default rules. Patterns use only what every common regex engine reads alike.
RULES = (
    Rule("product", "releas(e|es|ed)"),
    Rule("product", "launch"),
    Rule("product", "announc"),
    Rule("product", "introduc"),
    Rule("product", "unveil"),
    Rule("product", "now available"),
    Rule("product", "open beta"),
    Rule("product", r"v[0-9]+\.[0-9]+"),
    Rule("research", "paper"),
    Rule("research", "study"),
    Rule("research", "arxiv"),
    Rule("research", "researchers"),
    Rule("research", "breakthrough"),
    Rule("research", "findings"),
    Rule("promo", "discount"),
    Rule("promo", "[0-9]+% off"),
    Rule("promo", "coupon"),
    Rule("promo", "promo code"),
    Rule("promo", "early bird"),
    Rule("promo", "limited[- ]time"),
    Rule("promo", "sale"),
)

# How a callout names the kind of its source.
LABELS = {"reddit": "Reddit Post", "youtube": "YouTube Video", "rss": "Article", "scrape": "Article"}


def judged_text() -> Column:
    """Title and basis in lower case, without tags."""
    return F.lower(strip_tags(F.concat_ws(" ", F.col("title"), basis())))


def source_label(kind: Column) -> Column:
    """R6."""
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in LABELS.items()])


def score_items(items: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``product_score``, ``research_score`` and ``promo_score``: the weights of the rules that match at least
    once. A projection: neither a join with the rules nor a shuffle."""
    scored = items.withColumn("_judged", judged_text())
    sums = {}
    for category in CATEGORIES:
        hits = [F.when(F.col("_judged").rlike(r.pattern), r.weight).otherwise(0.0) for r in rules
                if r.category == category]
        sums[f"{category}_score"] = sum(hits, F.lit(0.0))
    return scored.withColumns(sums).drop("_judged")


def sections_of(threshold: float = 1.0) -> Column:
    """The sections an item belongs to. An offer belongs to no other section; one item may be both product and
    research news."""
    hit = {c: F.col(f"{c}_score") >= threshold for c in CATEGORIES}
    news = F.array_compact(
        F.array(F.when(hit["product"], F.lit("product")), F.when(hit["research"], F.lit("research")))
    )
    return F.when(hit["promo"], F.array(F.lit("promo"))).otherwise(news)


def callouts(items: DataFrame, rules=RULES, threshold: float = 1.0) -> DataFrame:
    """One row per item and section."""
    return (
        score_items(items, rules)
        .withColumn("section", F.explode(sections_of(threshold)))
        .withColumn("label", source_label(F.col("source_type")))
    )


def routine_items(items: DataFrame, rules=RULES, threshold: float = 1.0) -> DataFrame:
    """Items in no section; they count for the overview only."""
    return score_items(items, rules).filter(F.size(sections_of(threshold)) == 0).select(*items.columns)
