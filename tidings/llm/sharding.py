"""Operator 5, contiguous shards of nearly equal bytes (DataFrame functions only).

Rows are ordered by doc_id (then checksum and size) and dealt to range partitions. Each partition's rows and bytes are
totalled, the few totals are summed up, and a row's place is its partition's offset plus a running sum inside the
partition; no task sees more than a partition, and texts are read once and never shuffled. A row goes to the shard in
which the middle of its bytes falls when the total is cut into equal parts, so a shard differs from its share by less than
one document at either end.

Defined results: a null text has size 1 and checksum 0; null ids come first; repeated rows are rows of their own and lie
side by side; a third of all rows under one id or text is cut like any others (the order goes on to checksum and size,
and equal rows are interchangeable); other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.session import through_table

SHARDS = 8
ORDER = ["doc_id", "text_crc32", "size"]


def byte_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` per row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    # A dealt number spreads rows that are equal in all three over partitions; it is written, so it never changes.
    dealt = sized.withColumn("_deal", F.monotonically_increasing_id())
    ranged = dealt.repartitionByRange(*ORDER, "_deal").withColumn("block", F.spark_partition_id())
    ranged = through_table(ranged, "ranged")
    totals = ranged.groupBy("block").agg(F.sum("size").alias("n_bytes"), F.count("*").alias("n_rows"))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    # One row per partition of the range exchange: bounded by their number, not by the data.
    offsets = totals.select(
        "block", F.coalesce(F.sum("n_bytes").over(earlier), zero).alias("bytes_before"),
        F.coalesce(F.sum("n_rows").over(earlier), zero).alias("rows_before"), F.sum("n_bytes").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("block").orderBy(*ORDER, "_deal").rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumns({
        "_bytes": F.coalesce(F.sum("size").over(inside), zero), "_rows": F.coalesce(F.count("size").over(inside), zero),
    }).join(F.broadcast(offsets), "block")
    before = F.col("bytes_before") + F.col("_bytes")
    shard = F.expr(f"least({shards - 1}, ((2 * (bytes_before + _bytes) + size) * {shards}) div (2 * total))").cast("int")
    placed = through_table(placed.select(
        "doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("_rows")).alias("_row"), before.alias("start_byte")
    ), "placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"), "start_byte"
    )
