"""Byte streams as rows: (stream_id, data), from tables, files and file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_streams(df: DataFrame, key: str, text: str) -> DataFrame:
    """One stream for each row of a text column."""
    return df.select(F.col(key).alias("stream_id"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("data"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_streams(table(spark, sf_dir, "documents"), "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_streams(table(spark, sf_dir, "pages"), "page_id", "html")


def files(spark: SparkSession, path: str, content: bool = True, pattern: str = "*") -> DataFrame:
    """Files below a folder; without content only their catalogue is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    columns = [F.col("path").alias("stream_id"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return found.select(*columns, *([F.col("content").alias("data")] if content else []))


def stream_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def write_container(encoded: DataFrame, path: str) -> None:
    """Encoded chunks with their manifest columns as Parquet; the commit protocol makes it appear whole or not."""
    encoded.write.mode("overwrite").parquet(path)


def read_container(spark: SparkSession, path: str, versions: range = range(6, 11)) -> DataFrame:
    """Encoded chunks, of readable format versions only; raises on others when the rows are read."""
    chunks = spark.read.parquet(path)
    if "version" not in chunks.columns:
        return chunks
    fine = F.col("version").between(versions.start, versions.stop - 1)
    return chunks.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("unreadable version "), F.col("version").cast("string"))).cast("boolean")))
