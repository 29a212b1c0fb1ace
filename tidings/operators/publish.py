"""K1-K3, U4: what a run leaves behind: the archive, the digests and their index. All reruns replace their own day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions.dates import zoned_text
from tidings.operators.published import status_of
from tidings.schemas import DIGEST

DIGEST_TITLE = "# News Summary - "
INDEX_TITLE = "# News Summaries"


def archive_rows(items: DataFrame) -> DataFrame:
    """Items under the field names of the archived record; the place columns keep their order readable."""
    return items.select(
        "id", "title", "content", "url",
        zoned_text(F.col("publish_date"), F.col("publish_zone")).alias("publishDate"),
        "author",
        F.col("source_type").alias("sourceType"),
        F.col("source_name").alias("sourceName"),
        "metadata", "source_ord", "page_no", "item_pos", "run_date",
    )


def _replace_days(df: DataFrame):
    # AQE evens out the output files: a large day gets several, small ones share a task.
    return (
        df.hint("rebalance", "run_date").write.partitionBy("run_date").mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
    )


def write_archive(items: DataFrame, path: str) -> None:
    """K1: JSON lines by run day, nulls written out. Only the days present are replaced; no items, no day."""
    _replace_days(archive_rows(items)).option("ignoreNullFields", False).json(path)


def digests(bodies: DataFrame, as_of: Column) -> DataFrame:
    """K2: ``(run_date, part, generated_at, status, body)``; the first part opens with the title line."""
    header = F.concat(F.lit(DIGEST_TITLE), F.date_format(as_of, "yyyy-MM-dd HH:mm:ss"), F.lit("\n\n"))
    part = F.col("part") if "part" in bodies.columns else F.lit(0).cast("long")
    return bodies.select(
        "run_date", part.alias("part"), as_of.alias("generated_at"),
        status_of(F.col("body")).alias("status"),
        F.concat(F.when(part == 0, header).otherwise(F.lit("")), F.col("body")).alias("body"),
    )


def write_digests(rows: DataFrame, path: str) -> None:
    """K2: the digest table by run day."""
    _replace_days(rows).parquet(path)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIGEST).parquet(path)


def index_entries(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """K3, U4: the days of both, each once, with the line of its entry. The digest table alone is enough to make the
    index anew."""
    days = new.select("run_date").distinct()
    if existing is not None:
        days = existing.select("run_date").unionByName(days.join(existing, "run_date", "left_anti"))
    day = F.date_format("run_date", "yyyy-MM-dd")
    return days.select(
        "run_date",
        F.concat(F.lit("./"), day, F.lit("-summary.md")).alias("path"),
        F.concat(F.lit("- ["), day, F.lit("](./"), day, F.lit("-summary.md)")).alias("entry"),
    )


def index_text(entries: DataFrame) -> DataFrame:
    """K3: the index as one text, newest day on top. It has one line per calendar day."""
    listed = F.expr("listagg(entry, '\\n') within group (order by run_date desc)")
    return entries.agg(F.concat(F.lit(INDEX_TITLE + "\n\n"), listed, F.lit("\n")).alias("body"))
