"""Exact deduplication of blocks (stream_id, block_no, offset, length, cksum), in stream order.

First occurrences are minima found with partial aggregation and joined back, so a block that holds a third of all rows
is summed where it is read, and adaptive execution splits its side of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INDEX_ENTRY = 4
MAX_RUN = (1 << 30) - 1


def references(blocks: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Each block with kind (literal or exact) and the first block with its digest and length: ref_stream, ref_block.

    within: columns inside which alone duplicates count, such as ["stream_id"] for deduplication inside a chunk.
    """
    key = [*(within or []), "cksum", "length"]
    first = blocks.groupBy(*key).agg(F.min(F.struct("stream_id", "block_no")).alias("first"))
    out = blocks.join(first, key)
    here = (F.col("first.stream_id") == F.col("stream_id")) & (F.col("first.block_no") == F.col("block_no"))
    return out.select("stream_id", "block_no", "offset", "length", "cksum", F.when(here, "literal").otherwise("exact").alias("kind"), F.col("first.stream_id").alias("ref_stream"), F.col("first.block_no").alias("ref_block"))


def summary(blocks: DataFrame) -> DataFrame:
    """One row: blocks, bytes, and how many of both are duplicates."""
    each = blocks.groupBy("cksum", "length").agg(F.count("*").alias("n"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_blocks"), F.coalesce(F.sum(F.col("n") * F.col("length")), F.lit(0)).alias("n_bytes"), F.count("*").alias("n_unique"),
        F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("dup_blocks"), F.coalesce(F.sum((F.col("n") - 1) * F.col("length")), F.lit(0)).alias("dup_bytes"),
    )


def detail(refs: DataFrame, longest: int) -> DataFrame:
    """One row: blocks of the longest length that the cutting allows, and literal blocks that go on from another, so that
    an index merges them."""
    none = F.lit(0).cast("long")
    blocks = refs.agg(F.count_if(F.col("length") >= longest).alias("max_length_blocks"), F.count_if(F.col("kind") == "literal").alias("literals"), none.alias("entries"))
    entries = unique_runs(refs).agg(none.alias("max_length_blocks"), none.alias("literals"), F.count("*").alias("entries"))
    out = blocks.unionByName(entries).agg(F.sum("max_length_blocks").alias("max_length_blocks"), F.sum("literals").alias("literals"), F.sum("entries").alias("entries"))
    return out.select("max_length_blocks", "literals", (F.col("literals") - F.col("entries")).alias("merged"))


def unique_runs(refs: DataFrame, most: int = MAX_RUN) -> DataFrame:
    """Literal blocks that follow each other as one entry: stream_id, run, first_block, start, length, n_blocks."""
    order = Window.partitionBy("stream_id").orderBy("block_no")
    broken = (F.col("block_no") != F.coalesce(F.lag("block_no").over(order) + 1, F.lit(-1))).cast("int")
    rows = refs.where("kind = 'literal'").withColumn("_run", F.sum(broken).over(order))
    # a run over the most bytes that an entry can hold goes on in another
    upto = F.sum("length").over(Window.partitionBy("stream_id", "_run").orderBy("block_no")) - 1
    rows = rows.withColumn("_part", F.floor(upto / most))
    out = rows.groupBy("stream_id", "_run", "_part").agg(F.min("block_no").alias("first_block"), F.min("offset").alias("start"), F.sum("length").alias("length"), F.count("*").alias("n_blocks"))
    return out.withColumn("run", F.row_number().over(Window.partitionBy("stream_id").orderBy("first_block"))).drop("_run", "_part")


def worthwhile(refs: DataFrame, entry: int = INDEX_ENTRY) -> DataFrame:
    """For each stream whether deduplication saves more than its index takes."""
    out = refs.groupBy("stream_id").agg(F.count("*").alias("n_blocks"), F.sum(F.when(F.col("kind") == "exact", F.col("length")).otherwise(0)).alias("saved"))
    out = out.withColumn("index_bytes", F.col("n_blocks") * entry)
    return out.withColumn("worthwhile", (F.col("n_blocks") > 2) & (F.col("saved") >= F.col("index_bytes")))


def split_known(blocks: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks that are among the known ones, and the others."""
    keys = known.select("cksum", "length").distinct()
    return blocks.join(keys, ["cksum", "length"], "left_semi"), blocks.join(keys, ["cksum", "length"], "left_anti")


def segments(blocks: DataFrame, per_segment: int) -> DataFrame:
    """stream_id, segment_id and its blocks' digests; segments are so many consecutive blocks of a stream."""
    return blocks.withColumn("segment_id", F.expr(f"block_no div {per_segment}"))
