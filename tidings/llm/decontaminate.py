"""Operator 3, benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size: class ``s`` holds the items of ``2**s`` to ``2**(s+1) - 1`` shingles. An item's sketch is
its bottom-k MinHash, the k shingles of least hash under one random permutation. A document that holds at least 75 % of
an item's q shingles misses at most q // 4 of them, so with k = upper size of the class // 4 + 1 it must hold one
of the sketch: the search can't miss, however long the document is and however scattered the match, while long items
still search with about a third of their shingles. (Comparing whole-document MinHash signatures instead would need
thousands of values to see 10 shingles among 10,000.) Candidates are then verified on the full sets: shared shingles
against the item's.

Sketches are joined with the documents' shingles by value. Their table is written first, so Spark knows its size and
broadcasts it only below its threshold; larger benchmarks are joined by a shuffle. The same holds for the candidates.

Defined results: a null or wordless text or item matches nothing; fewer than five words are one shingle, so a shorter
item is found only in a document of exactly these words; equal items match alike, each under its own id; repeated rows
are one row of the result; null ids stay null and are told apart by their text; other columns are ignored; an empty
table on either side gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import free_name, prepare
from tidings.llm.words import mix, shingle_sets
from tidings.session import through_table

PERCENT = 75
_SEED = np.uint64(0x5851F42D4C957F2D)


def _sets(texts: pa.Array) -> pa.Array:
    sets = list(shingle_sets(texts))
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), _sets(batch.column("text"))], ["doc_id", "text_key", "shingles"]
        )


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The bottom-k MinHash of an item; k follows from the upper size of its class."""
    upper = (1 << len(shingles).bit_length()) - 1
    k = min(len(shingles), upper * (100 - PERCENT) // 100 + 1)
    return shingles[np.argsort(mix(shingles ^ _SEED), kind="stable")[:k]]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("item_id"),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([sketch(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([len(s).bit_length() - 1 for s in sets], pa.int32()),
            ],
            ["item_id", "item_shingles", "sketch", "size_class"],
        )


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, text_key, item_id, size_class, n_item_shingles, n_shared)``, one row per document and item found."""
    prepare(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    schema = "doc_id long, text_key long, shingles array<long>"
    item_sets = through_table(
        items.select(F.col("item_id").cast("long"), "text").mapInArrow(_items, "item_id long, item_shingles array<long>, sketch array<long>, size_class int")
        .filter(F.size("item_shingles") > 0).withColumn("item_key", F.xxhash64("item_id", "item_shingles")).distinct(),
        "items",
    )
    anchors = through_table(item_sets.select("item_key", F.explode("sketch").alias("shingle")), "sketches")
    found = keyed.mapInArrow(_documents, schema).select("doc_id", "text_key", F.explode("shingles").alias("shingle")).join(anchors, "shingle")
    candidates = through_table(found.select("doc_id", "text_key", "item_key").distinct(), "candidates")
    # A document is read again only if it is a candidate, and then once for all its items.
    wanted = through_table(candidates.select("doc_id", "text_key").distinct(), "wanted")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    texts = keyed.join(wanted, same(keyed, wanted), "left_semi").dropDuplicates(["doc_id", "text_key"])
    sets = texts.mapInArrow(_documents, schema)
    return (
        candidates.join(sets, same(candidates, sets)).select(candidates["doc_id"], candidates["text_key"], "item_key", "shingles")
        .join(item_sets.drop("sketch"), "item_key")
        .withColumn("n_item_shingles", F.size("item_shingles").cast("long"))
        .withColumn("n_shared", F.size(F.array_intersect("shingles", "item_shingles")).cast("long"))
        .filter(F.col("n_shared") * 100 >= F.col("n_item_shingles") * PERCENT)
        .select("doc_id", "text_key", "item_id", "size_class", "n_item_shingles", "n_shared")
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    own_id, key = free_name(docs, "_id"), free_name(docs, "text_key")
    found = through_table(contaminations(docs, items).select(F.col("doc_id").alias(own_id), F.col("text_key").alias(key)).distinct(), "found")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(key))
    return docs.join(found, same, "left_anti")
