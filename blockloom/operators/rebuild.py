"""Streams back from blocks and references, and their verification."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import delta
from blockloom.shared import mapped


def stored(refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """What a deduplicated store holds: references for all blocks, data for the literal ones alone."""
    literal = refs.where("kind = 'literal'").select("stream_id", "block_no").join(blocks.select("stream_id", "block_no", "data"), ["stream_id", "block_no"])
    return refs.join(literal, ["stream_id", "block_no"], "left")


def stored_similar(refs: DataFrame, blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """As stored(), with patches in place of literal blocks that are similar to another literal block.

    pairs (stream_id, block_no, ref_stream, ref_block), as of similarity.similar_blocks: the other block is the first of
    its sketch, so it is similar to none itself and is kept whole. A block whose patch is no shorter stays literal.
    """
    data = blocks.select("stream_id", "block_no", "data")
    literal = refs.where("kind = 'literal'").select("stream_id", "block_no")
    found = pairs.select("stream_id", "block_no", F.col("ref_stream").alias("base_stream"), F.col("ref_block").alias("base_block")).join(literal, ["stream_id", "block_no"], "left_semi")
    old = data.select(F.col("stream_id").alias("base_stream"), F.col("block_no").alias("base_block"), F.col("data").alias("old"))
    both = found.join(data, ["stream_id", "block_no"]).join(old, ["base_stream", "base_block"])
    kind = refs.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patches = [delta.diff(o.as_py(), n.as_py()) for o, n in zip(batch.column(4), batch.column(5), strict=True)]
            less = pa.array([len(p) < len(n.as_buffer()) for p, n in zip(patches, batch.column(5), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(patches, pa.binary())], names=["stream_id", "block_no", "base_stream", "base_block", "patch"]).filter(less)

    made = both.select("stream_id", "block_no", "base_stream", "base_block", "old", "data").transform(mapped, run, f"stream_id {kind}, block_no long, base_stream {kind}, base_block long, patch binary")
    store = stored(refs, blocks).join(made, ["stream_id", "block_no"], "left")
    is_similar = F.col("patch").isNotNull()
    return store.select(
        "stream_id", "block_no", "offset", "length", "cksum", F.when(is_similar, "similar").otherwise(F.col("kind")).alias("kind"),
        F.coalesce("base_stream", "ref_stream").alias("ref_stream"), F.coalesce("base_block", "ref_block").alias("ref_block"), F.coalesce("patch", "data").alias("data"),
    )


def originals(store: DataFrame) -> DataFrame:
    """ref_stream, ref_block and body of every block that references lead to: literal ones, and similar ones patched."""
    literal = store.where("kind = 'literal'").select(F.col("stream_id").alias("ref_stream"), F.col("block_no").alias("ref_block"), F.col("data").alias("body"))
    similar = store.where("kind = 'similar'").join(literal, ["ref_stream", "ref_block"]).select("stream_id", "block_no", "body", "data")
    kind = store.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [delta.patch(old.as_py(), p.as_py()) for old, p in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bodies, pa.binary())], names=["ref_stream", "ref_block", "body"])

    return literal.unionByName(similar.transform(mapped, run, f"ref_stream {kind}, ref_block long, body binary"))


def rebuilt(store: DataFrame) -> DataFrame:
    """stream_id, data: a reference leads to a literal or a similar block, and a similar block's to a literal one."""
    own = F.col("kind") == "similar"
    rows = store.select("stream_id", "block_no", F.when(own, F.col("stream_id")).otherwise(F.col("ref_stream")).alias("ref_stream"), F.when(own, F.col("block_no")).otherwise(F.col("ref_block")).alias("ref_block"))
    rows = rows.join(originals(store), ["ref_stream", "ref_block"])
    parts = rows.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "body"))).alias("parts")).select("stream_id", "parts.body")
    kind = store.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1), strict=True):  # each may be large
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), pa.array([b"".join(body.as_py())], pa.binary())], names=["stream_id", "data"])

    return parts.transform(mapped, run, f"stream_id {kind}, data binary")


def verified(streams: DataFrame, restored: DataFrame) -> DataFrame:
    """stream_id and whether a stream came back as it was; an empty stream has no blocks and counts as equal."""
    want = streams.select("stream_id", F.sha2("data", 256).alias("want"), F.octet_length("data").alias("n"))
    have = restored.select("stream_id", F.sha2("data", 256).alias("have"))
    return want.join(have, "stream_id", "left").select("stream_id", F.coalesce(F.col("want") == F.col("have"), F.col("n") == 0).alias("equal"))
