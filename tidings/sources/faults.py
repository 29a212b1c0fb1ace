"""What a payload got wrong, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_rows(parsed: DataFrame, stage: str, reasons: Column) -> DataFrame:
    """A row per reason, from payloads that are parsed already (``source_name, body_sha`` and what the reasons need)."""
    found = parsed.select("source_name", F.lit(stage).alias("stage"), F.explode(reasons).alias("reason"), "body_sha")
    return found.select("source_name", "stage", "reason", "body_sha")
