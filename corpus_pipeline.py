"""A training corpus from raw documents: each stage a function of ``(spark, docs, sf_dir)``.

Every stage works on all that its predecessor kept. All but the last return the columns of documents; the last returns
each remaining document's pieces. Columns beyond the five pass through as they are. Decisions are joined back by doc_id and
text, both null-safe, so with null or repeated ids they fall on exactly the rows they were made for. Empty tables give
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm import decontaminate, near_dedup, pieces, pii, quality
from tidings.llm.common import prepare, table
from tidings.session import new_table_path

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or their group's thresholds reject."""
    return quality.kept_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose id names the group, once."""
    return near_dedup.kept_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text where it is there."""
    masked = pii.mask(docs)
    if "n_chars" not in masked.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces under merge dropout, and whether they decode to its text."""
    read = pieces.decoded(pieces.encode(docs, PIECE_MODEL), PIECE_MODEL)
    return read.select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_dedup_stage),
    ("decontamination", decontamination),
    ("personal data", pii_masking),
    ("pieces", piece_encoding),
]

#: The trained field of the fourth stage and the merges of the last are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written once and read again by the next."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_table_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
