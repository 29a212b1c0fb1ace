"""The operators as queries over the whole test tables, with SQL where it can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm import (
    decontaminate, hard_negatives, language_model, lexical_search, near_dedup, pieces, pii, quality, repeats, sharding, sqltext, token_counts, toxicity, warc,
)
from tidings.llm.common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            prepare(spark)
            return run(spark, sf_dir)

        QUERIES[name] = prepared
        if sql:
            SQL[name] = sql
        return run

    return register


@query("op2_quality_rules", sqltext.OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op3_decontaminate", sqltext.OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "n_item_shingles", "n_shared"
    )


@query("op5_byte_shards", sqltext.OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op9_minmax_dedup", sqltext.OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


TOKENIZERS = "/opt/tokenizers"


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN)
    return counted.withColumn("section_tokens", F.array_join(F.col("section_tokens").cast("array<string>"), ","))


@query("op10_merge_dropout")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    read = pieces.decoded(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return read.select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


@query("op6_arc_to_warc", sqltext.OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages_through_archives(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op4_class_bigrams")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


@query("op8_factorization_machine")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_semi_markov_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", sqltext.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


@query("op12_lexical_search", sqltext.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


@query("op13_suffix_dedup", sqltext.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
