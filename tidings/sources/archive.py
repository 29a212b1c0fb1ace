"""Reading back archives and published digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions.dates import iso_zone, iso_zoned
from tidings.schemas import ARCHIVE


def read_archive(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Archived items; ``layout='array'`` reads files that hold one JSON array each."""
    schema = ARCHIVE if layout == "array" else ARCHIVE + ", run_date date, source_ord int, page_no int, item_pos int"
    raw = spark.read.schema(schema).option("multiLine", layout == "array").json(path)
    return raw.select(
        "id", "title", "content", "url",
        iso_zoned(F.col("publishDate")).alias("publish_date"),
        iso_zone(F.col("publishDate")).alias("publish_zone"),
        "author",
        F.lower("sourceType").alias("source_type"),
        F.col("sourceName").alias("source_name"),
        "metadata",
        *[c for c in ("run_date", "source_ord", "page_no", "item_pos") if c in raw.columns],
    )


def read_digest_files(spark: SparkSession, path: str) -> DataFrame:
    """The text files below ``path`` as ``(path, body)``."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def list_digests(files: DataFrame) -> DataFrame:
    """Every Markdown file but the index, by name, with the day its name starts with.

    Sort by ``name`` descending for the newest-first list.
    """
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.filter(F.col("path").contains(".md") & (name != "index.md"))
        .withColumn("name", F.replace(name, F.lit(".md"), F.lit("")))
        .withColumn("run_date", F.to_date(F.nullif(F.regexp_extract("name", r"^\d{4}-\d{2}-\d{2}", 0), F.lit(""))))
    )
