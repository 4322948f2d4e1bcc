"""A corpus pipeline of five stages over ``documents``; each works on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents, the
mix with a training position, too. The
stages count over the rows that reach them: the fences of the quality rules over all documents, near copies among those
that pass, personal data over one of each group, the mix over sanitised texts. An empty table gives an empty one. Columns
beside doc_id, text, lang and source are carried as they are, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import byte_bpe, near_dedup, pii, quality_rules, source_mix
from keelson.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Null and empty texts fail the base rules; an empty table stays empty."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of least doc_id; of equal rows one. Texts without words all stay."""
    return near_dedup.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the text; n_chars follows the text (null for a null
    one). Rows are neither lost nor merged, and other columns stay as they are."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, none to three, with the copy's training position (``position``;
    a column of that name is replaced) and range-sorted by it. Of rows equal in doc_id, source and text each is taken
    like the one that is taken most. Nulls as in source_mix.plan()."""
    placed = source_mix.plan(docs.select("doc_id", "source", "text")).where("copies > 0")
    taken = placed.groupBy(F.col("doc_id").alias("k"), F.col("source").alias("s"), F.col("text_hash").alias("h")).agg(F.max_by("positions", "copies").alias("positions"))
    row = docs.select("doc_id", "source", source_mix.text_number().alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "position")).alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("text_hash") == F.col("h"))
    return source_mix.in_training_order(row.join(written(taken, "mix-taken"), same).select("row", "positions")).select("row.*", "position")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256), a row for each row that came in; a null text is the empty one."""
    done = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near dedup", near_copies), ("personal data", personal_data), ("source mix", mix), ("byte bpe", tokens)]
#: SQL can't express the near-copy and sanitising stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"stage-{n}")
    return docs
