"""Transcripts as metadata, and the text an item is judged by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRANSCRIPTION = "transcription"


def add_transcripts(items: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The transcript of an item's url as its last metadata entry; items without one stay as they are.

    ``transcripts`` has ``url, transcript`` with one row per url. Cap the items first: only what is kept needs one.
    """
    others = F.map_filter("metadata", lambda k, v: k != TRANSCRIPTION)
    extended = F.map_concat(others, F.create_map(F.lit(TRANSCRIPTION), F.col("transcript")))
    joined = items.join(transcripts.select("url", "transcript"), "url", "left")
    return joined.withColumn(
        "metadata", F.when(F.col("transcript").isNull(), F.col("metadata")).otherwise(extended)
    ).select(*items.columns)


def basis() -> Column:
    """A video's transcript if there is one, else the content."""
    return F.coalesce(F.try_element_at("metadata", F.lit(TRANSCRIPTION)), F.col("content"))
