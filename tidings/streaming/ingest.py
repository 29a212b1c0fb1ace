"""Incremental runs on Structured Streaming. Caps and ordered texts stay batch work (``for_each_batch``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidings.operators.ordered import SLOTS
from tidings.session import new_table_path


def landed_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """Payload files below ``path`` as they arrive."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def drop_refetched(
    items: DataFrame, delay: str, time: str = "fetched_at", spread: list[str] | None = None,
) -> DataFrame:
    """Each ``(source_name, id)`` once, as long as its copies are fetched within ``delay`` of each other. Lateness is that of
    the fetch and not of the item: an old article that was never seen is new.

    ``spread`` names columns in which copies differ (when or where they were fetched). Copies are then first dropped
    inside slots of these, so that an item fetched without end is not one task's work; the price is a second state.
    """
    marked = items.withWatermark(time, delay)
    if spread:
        slotted = marked.withColumn("_slot", F.pmod(F.xxhash64(*spread), F.lit(SLOTS)))
        marked = slotted.dropDuplicatesWithinWatermark(["source_name", "id", "_slot"]).drop("_slot")
    return marked.dropDuplicatesWithinWatermark(["source_name", "id"])


def daily_counts(items: DataFrame, delay: str, time: str = "publish_date", by: tuple[str, ...] = ("source_type",)):
    """Items per day and type. A day is given out once ``delay`` has passed since its end; later rows are late."""
    day = F.window(time, "1 day")
    counted = items.withWatermark(time, delay).groupBy(day, *by).agg(F.count("*").alias("items"))
    return counted.select(F.to_date("window.start").alias("day"), *by, "items")


def run_available(
    stream: DataFrame, name: str, output: str | None = None, checkpoint: str | None = None,
) -> tuple[StreamingQuery, str]:
    """Process everything that has landed, append it to a parquet table, and stop: one run of the daily schedule.

    ``output`` and ``checkpoint`` given again go on where the last run ended.
    """
    spark = stream.sparkSession
    output = output or new_table_path(spark, name)
    checkpoint = checkpoint or new_table_path(spark, f"{name}-progress")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", output)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query, output


def for_each_batch(
    stream: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str,
) -> StreamingQuery:
    """Batch operators (caps, ordered texts, partition-replacing sinks) on each micro-batch of what has landed."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: handle(batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_run(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table a run has written so far."""
    return spark.read.schema(like.schema).parquet(path)
