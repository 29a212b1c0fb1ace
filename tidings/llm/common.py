"""What the operators share: session settings, document columns, exact Jaccard links and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.words import shared_count, shingle_sets
from tidings.session import ship_package, through_table

BATCH_ROWS = 1000
BATCH_BYTES = "16m"


def prepare(spark: SparkSession) -> None:
    """Let workers import the package, and bound the batches they get by bytes as well as by rows."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_by_crc(column: str, modulus: int, remainder: int):
    """Whether crc32 of a number as text has this remainder; false for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def component_labels(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)``: the smallest node it is connected with.

    Labels travel along links and then jump to their own label, so the rounds grow with the logarithm of the longest
    path. Each round is a written table; a node's links are reduced to their minimum before the shuffle, so a hub costs
    no task more than its neighbours.
    """
    edges = through_table(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))),
        "edges",
    )
    labels = through_table(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label")
        nearest = labels.unionByName(heard).groupBy("node").agg(F.min("label").alias("label"))
        nearest = through_table(nearest, "labels")
        jump = nearest.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = through_table(nearest.join(jump, "label").select("node", F.col("next").alias("label")), "labels")
        changed = step.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old")
        if changed.isEmpty():
            return step
        labels = step


LINK_SCHEMA = "a long, b long, shared long, total long"


def _verified(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            # A leader's rows come together, so most batches need the sets of very few leaders.
            fresh = {x: i for i, x in enumerate(a) if x != known[0]}
            leaders = dict(zip(fresh, shingle_sets(batch.column("text_a").take(pa.array(list(fresh.values()), pa.int64()))), strict=True))
            if known[0] is not None:
                leaders[known[0]] = known[1]
            out = []
            for x, y, other in zip(a, b, shingle_sets(batch.column("text_b")), strict=True):
                own = leaders[x]
                shared = shared_count(own, other)
                total = len(own) + len(other) - shared
                if shared and 100 * shared >= limit * total:
                    out.append((x, y, shared, total))
            if a:
                known = (a[-1], leaders[a[-1]])
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "shared", "total"])

    return run


def verified_links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets have a Jaccard similarity of ``percent`` or more.

    ``texts(set_id, text)`` has one row per set. Both joins are on one side's unique key, so adaptive execution can
    split a leader's many pairs."""
    second = pairs.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(percent), LINK_SCHEMA)


_shipped_files: set[tuple[str, str]] = set()


def ship_file(spark: SparkSession, path: str) -> None:
    """Hand a local file of a model or vocabulary to all workers, once per application."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _shipped_files:
        spark.sparkContext.addFile(path)
        _shipped_files.add(key)
