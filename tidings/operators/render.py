"""The digest as Markdown, line by line, without a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import preview, strip_tags
from tidings.operators.callouts import RULES, callouts
from tidings.operators.enrich import basis
from tidings.operators.grouping import exact_key, primaries, standing
from tidings.operators.ordered import PAGES_PER_BLOCK, joined_text
from tidings.operators.themes import overview, themes
from tidings.session import through_table

TITLE = "## Unified Content Digest"
OVERVIEW = "**Global Overview:**"
KEY = "**Key Information:**"

# Section headings in their order. 0 and 1 are the title and the overview.
HEADINGS = {
    "product": (3, "### Product Announcements & Releases"),
    "research": (4, "### Research Breakthroughs & Significant Findings"),
    "promo": (5, "**Promotional Offers:**"),
}
LINE = ("run_date", "part_no", "source_ord", "page_no", "item_pos", "line")
MAX_DIGEST_CHARS = 2_000_000


def _section_no(section: Column) -> Column:
    return F.coalesce(*[F.when(section == s, F.lit(n)) for s, (n, _) in HEADINGS.items()])


def bullet() -> Column:
    """``*   **title:** summary - (Source: label - [url](url))``"""
    summary = preview(F.trim(F.regexp_replace(strip_tags(basis()), r"\s+", " ")))
    return F.concat(
        F.lit("*   **"), F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit(":** "), summary,
        F.lit(" - (Source: "), F.col("label"), F.lit(" - ["), F.col("url"), F.lit("]("), F.col("url"), F.lit("))"),
    )


def _lines(df: DataFrame, part: Column | int, text: Column | str, position: Column | int = -1) -> DataFrame:
    """Lines that belong to no item; they stand before the items of their part."""
    part = F.lit(part) if isinstance(part, int) else part
    text = F.lit(text) if isinstance(text, str) else text
    position = F.lit(position) if isinstance(position, int) else position
    return df.select(
        "run_date", part.alias("part_no"), F.lit(-1).alias("source_ord"), F.lit(0).cast("long").alias("page_no"),
        position.cast("int").alias("item_pos"), text.alias("line"),
    )


def callout_lines(items: DataFrame, rules=RULES, threshold: float = 1.0) -> DataFrame:
    """Headings and bullets. Equal titles give one bullet, linked to their primary source; a section without bullets is
    left out."""
    keep = ["source_ord", "page_no", "item_pos", "line"]
    called = callouts(items, rules, threshold).select(
        "run_date", "section", exact_key().alias("group_key"), "source_ord",
        F.col("page_no").cast("long").alias("page_no"), F.col("item_pos").cast("int").alias("item_pos"),
        bullet().alias("line"), standing().alias("standing"),
    )
    # Bullets and headings both read the callouts; the rules go over the texts only once.
    found = through_table(called, "callouts")
    chosen = primaries(found, ["run_date", "section", "group_key"], keep, F.col("standing"))
    bullets = chosen.select("run_date", _section_no(F.col("section")).alias("part_no"), *keep)
    sections = found.select("run_date", "section").distinct()
    heading = F.coalesce(*[F.when(F.col("section") == s, F.lit(h)) for s, (_, h) in HEADINGS.items()])
    # Offers stand under a heading of their own; a day of offers alone has no key information.
    days = sections.filter("section <> 'promo'").select("run_date").distinct()
    return _all(
        bullets,
        _lines(days, 2, ""),
        _lines(days, 2, KEY, 0),
        _lines(sections, _section_no(F.col("section")), ""),
        _lines(sections, _section_no(F.col("section")), heading, 0),
    )


def overview_lines(items: DataFrame) -> DataFrame:
    """The title of each day, and its overview if there is something to say."""
    days = items.select("run_date").distinct()
    # A few sentences a day, wanted in two places.
    said = through_table(overview(items, themes(items)), "overview")
    return _all(
        _lines(days, 0, TITLE),
        _lines(days, 0, "", 0),
        _lines(said.select("run_date").distinct(), 1, OVERVIEW),
        _lines(said, 1, F.regexp_replace("sentence", r"([^.!?])$", "$1."), F.col("rank")),
    )


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def digest_lines(items: DataFrame, rules=RULES, threshold: float = 1.0) -> DataFrame:
    """Every line of every day's digest with its place."""
    return _all(callout_lines(items, rules, threshold), overview_lines(items))


def digest_bodies(lines: DataFrame, max_chars: int = MAX_DIGEST_CHARS) -> DataFrame:
    """The lines of a day as ``(run_date, part, body)``; a day below ``max_chars`` is one part."""
    order = ["part_no", "source_ord", "page_no", "item_pos", "line"]
    blocks = {
        "_part": F.col("part_no"), "_source": F.col("source_ord"), "_pages": F.expr(f"page_no div {PAGES_PER_BLOCK}"),
    }
    joined = joined_text(lines, "line", "\n", ["run_date"], blocks, order, max_chars)
    return joined.withColumnRenamed("line", "body")
