"""A training-data pipeline of five stages, each written as Parquet and read again as the next one's documents.

1. quality: documents that a base or repetition rule rejects go.
2. near_duplicates: of each group of documents linked by n-gram Jaccard similarity, the smallest doc_id stays.
3. secrets: every secret span in a text is replaced by a mark; n_chars follows.
4. mixture: documents are repeated or left out so that the sources' words come near their targets.
5. tokens: texts become sentencepiece ids, and these are decoded again.

All but the last return the columns of documents; further columns go along, whatever their names. Null and empty texts
fail the quality rules; a stage that is given them anyway keeps them as they are, but for the mixture, which takes no
document without words. Texts are worked on whole, however long. Equal texts and ties: see near_duplicate_stage; other
stages judge row by row. Empty tables give empty results. ORACLE_SQL is None: hashing orders, zstandard and the tokenizer have no
SQL; tests hold the stages against brute force instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.jaccard import jaccard_components
from blockloom.llm.mixing import copies, mixed
from blockloom.llm.quality import quality
from blockloom.llm.secrets import secrets
from blockloom.llm.sentencepieces import pieces
from blockloom.llm.shared import carried, checkpoint_dir, dropped

ORACLE_SQL = None
MODEL = "piece_bpe_32k.model"


def _through(docs: DataFrame, used: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of docs after a step over the used ones; others go along, whatever they are called."""
    held, columns = carried(docs, used)
    out = step(held)
    return out.select(*columns(out))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _through(docs, ("doc_id", "text"), lambda held: quality(held).where("kept"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal or linked texts: that of the smallest doc_id. Rows without an id stay.

    A document is a doc_id with its text, so different texts under one doc_id are judged each for itself. Ties go by a
    hash of the text; of rows equal in both, the one whose other columns come first as JSON stays.
    """
    held, columns = carried(docs, ("doc_id", "text"))
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("_key")
    texts = held.where("doc_id IS NOT NULL").select(key, "text", "doc_id")
    found = jaccard_components(texts.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), F.col("component_id").alias("_group"))
    named = found.distinct().join(texts.select("_key", "doc_id").distinct(), "_key")
    first = named.groupBy("_group").agg(F.min(F.struct("doc_id", "_key"))["_key"].alias("_key")).select("_key")
    rows = held.withColumn("_key", key).join(first, "_key", "left_semi")
    rest = F.to_json(F.struct(*(F.col(c) for c in held.columns if c != "text")))
    one = rows.groupBy("_key").agg(F.min_by(F.struct(*held.columns), rest).alias("_row")).select("_row.*")
    return one.select(*columns(one)).unionByName(docs.where("doc_id IS NULL"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chars = F.when(F.col("spans") != "", F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return _through(docs, ("doc_id", "text", "n_chars"), lambda held: secrets(held, redact=True).withColumn("n_chars", chars))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _through(docs, ("doc_id", "source", "text"), lambda held: copies(mixed(held)))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(MODEL)).drop("text")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("secrets", secret_stage), ("mixture", mixture_stage), ("tokens", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir; what each returns is kept in the shared folder until the next is done."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            dropped(spark, before)
        before = f"{folder}/{name}"
    return docs
