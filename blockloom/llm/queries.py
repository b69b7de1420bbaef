"""One thin query per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.chat import mismatched_replies, preference_pairs

    return preference_pairs(mismatched_replies(table(spark, sf_dir, "conversations")), F.col("pair_id"), F.col("side"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(~langid.held_out()).select("lang", "text"))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.sharding import shards

    out = shards(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm import warc

    path = warc.archive_path(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    out = warc.read_archives(spark, path, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.quality import quality

    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_chars", *(c for c in out.columns if c.endswith("gram_chars")), F.array_join("failed", ",").alias("failed"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from blockloom.llm.sentencepieces import pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), digests_only=True).drop("text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.mixing import mixed

    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), drop_text=True)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from blockloom.llm.secrets import secrets

    return secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = (
    op1_ngram_jaccard_join, op2_chat_formatting, op3_language_id, op4_sharding, op5_warc, op6_quality_rules,
    op7_embedding_near_dedup, op8_sentencepiece, op9_mixing, op10_secret_scans,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from blockloom.llm.oracles import ORACLES

    return dict(ORACLES)
