"""The queries opN_<name>: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import ann_forest, byte_bpe, near_dedup, pii, quality_classifier, quality_rules, secret_scan, source_mix, suffix_dedup, token_counts
from keelson.llm.common import documents

RANKS = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
PREDICTED_AT = 0.7


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    done = byte_bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"), path, pattern)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir, "doc_id", "text"), secret_scan.ledger_of(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    weights = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, weights)
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICTED_AT).cast("int").alias("predicted"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("positions", F.lit(0))
    placed = source_mix.plan(documents(spark, sf_dir, "doc_id", "source", "text"))
    placed = placed.select("doc_id", "size", "source_size", "target", "taken", "copies", first.alias("first_position"))
    order = F.col("first_position").asc_nulls_last()
    return placed.repartitionByRange(order, F.col("doc_id")).sortWithinPartitions(order, "doc_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir, "doc_id", "text"))
    base = pii.joined_spans(*pii.KINDS)
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.joined_spans(*pii.KINDS, "terms").alias("spans"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path(WORD_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))


def op2_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann_forest.search(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(documents(spark, sf_dir, "doc_id", "text")).drop("text_hash")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.dedup(documents(spark, sf_dir, "doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
