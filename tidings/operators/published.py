"""Published digests back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The headings digests use for their sections.
SECTION_HEADINGS = {
    "**Global Overview:**": "overview",
    "**Key Information:**": "key",
    "### Product Announcements & Releases": "product",
    "### Research Breakthroughs & Significant Findings": "research",
    "**Promotional Offers:**": "promo",
    "### Promotional Offers": "promo",
}
HEADER = r"^# News Summary - (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
HEADING = r"^(#{1,6} .*|\*\*[^*]+:\*\*)\s*$"
BULLET = r"^\s*[*-]\s+"
LINK = r"\]\((https?://[^)\s]+)\)"
FAILED = r"^(Error generating summary:|Failed to generate summary\.)"


def generated_at(body: Column) -> Column:
    """The time in the title line; null without one."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(body, "(?m)" + HEADER, 1), F.lit("")))


def content_of(body: Column) -> Column:
    """The digest without front matter and title line."""
    bare = F.regexp_replace(body, r"^---\n(?:[^\n]*\n)*?---\n", "")
    return F.regexp_replace(bare, HEADER + r"[^\n]*\n\s*", "")


def status_of(body: Column) -> Column:
    """``failed`` if the text is what a failing model left behind."""
    return F.when(content_of(body).rlike(FAILED), "failed").otherwise("ok")


def digest_status(files: DataFrame) -> DataFrame:
    return files.select("path", generated_at(F.col("body")).alias("generated_at"),
                        status_of(F.col("body")).alias("status"))


def _lines(files: DataFrame) -> DataFrame:
    """Every line with the section it stands in and whether it is that section's heading.

    Lines are windowed inside one file, whose size is that of one row.
    """
    lines = files.select("path", F.posexplode(F.split(content_of(F.col("body")), "\n")).alias("line_no", "line"))
    trimmed = F.rtrim("line")
    known = F.coalesce(*[F.when(trimmed == h, F.lit(s)) for h, s in SECTION_HEADINGS.items()])
    named = F.when(F.col("line").rlike(HEADING), F.coalesce(known, F.lit("other")))
    above = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("heading", named).withColumn("section", F.last("heading", True).over(above))


def digest_rows(files: DataFrame) -> DataFrame:
    """The lines below each heading with their section; bullets (also indented ones) with title, source label and
    first link."""
    rows = _lines(files).filter("heading is null and trim(line) <> ''")
    is_bullet = F.col("line").rlike(BULLET)

    def part(pattern: str) -> Column:
        return F.when(is_bullet, F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")))

    return rows.select(
        "path", "line_no", "section",
        F.when(is_bullet, "bullet").otherwise("text").alias("kind"),
        F.regexp_replace("line", BULLET, "").alias("text"),
        part(BULLET + r"\*\*(.*?):?\*\*").alias("title"),
        part(r"\(Source: ([^\[\]()]*?)(?: - \[|\))").alias("label"),
        part(LINK).alias("url"),
    )


def digest_links(files: DataFrame) -> DataFrame:
    """Every link of every line, headings included, in order."""
    found = F.regexp_extract_all("line", F.lit(LINK), F.lit(1))
    return _lines(files).select("path", "line_no", "section", F.posexplode(found).alias("link_no", "url"))
