"""Similar segments and similar blocks by sketches of smallest values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.shared import mapped

SKETCH = 20
#: Eighths of a block's words that its sketch holds, by the average block size that it starts from; "extra" has 5.
EXTENT = ((1 << 16, 4), (1 << 14, 5), (0, 7))


def segment_sketches(segmented: DataFrame, k: int = SKETCH) -> DataFrame:
    """segment rows with sketch: the k smallest distinct 8-byte pieces of the digests of its blocks, as hex.

    Hex strings of one length sort as unsigned numbers do.
    """
    pieces = F.array(*(F.substring("cksum", 1 + 16 * i, 16) for i in range(4)))
    rows = segmented.select("stream_id", "segment_id", F.explode(pieces).alias("piece")).distinct()
    return rows.groupBy("stream_id", "segment_id").agg(F.slice(F.array_sort(F.collect_set("piece")), 1, k).alias("sketch"))


def segment_candidates(sketches: DataFrame) -> DataFrame:
    """Pairs of a segment and the first segment that has one of its sketch values: stream_id, segment_id, ref_*.

    A value belongs to the first segment that used it, so a value common to many gives one pair for each, not all.
    """
    rows = sketches.select("stream_id", "segment_id", F.explode("sketch").alias("piece"))
    owner = rows.groupBy("piece").agg(F.min(F.struct("stream_id", "segment_id")).alias("o"))
    pairs = rows.join(owner, "piece").where(F.struct("stream_id", "segment_id") > F.col("o"))
    return pairs.select("stream_id", "segment_id", F.col("o.stream_id").alias("ref_stream"), F.col("o.segment_id").alias("ref_segment")).distinct()


def segment_dedupe(segmented: DataFrame, candidates: DataFrame) -> DataFrame:
    """Blocks that a candidate segment holds too, with the first such place."""
    theirs = segmented.select(F.col("stream_id").alias("ref_stream"), F.col("segment_id").alias("ref_segment"), F.col("block_no").alias("ref_block"), "cksum", "length")
    found = segmented.join(candidates, ["stream_id", "segment_id"]).join(theirs, ["ref_stream", "ref_segment", "cksum", "length"])
    return found.groupBy("stream_id", "block_no", "length").agg(F.min(F.struct("ref_stream", "ref_block")).alias("r")).select("stream_id", "block_no", "length", F.col("r.ref_stream").alias("ref_stream"), F.col("r.ref_block").alias("ref_block"))


def extent(average: int, extra: bool) -> int:
    return 5 if extra else next(e for least, e in EXTENT if average >= least)


def sketch(block: bytes, eighths: int, least: int) -> int:
    """A hash of the smallest 64-bit words of a block; a block of `least` bytes or fewer is hashed whole.

    These are the true smallest values in order, which is stricter than a heap that loses some of them. The hash has 64
    bits, as a signed number: with 32, a few of some hundred thousand blocks share one with a block that is not similar.
    """
    if len(block) <= least or len(block) < 8:
        return signed(block)
    words = np.frombuffer(block, "<i8", len(block) // 8)
    k = max(1, len(words) * eighths // 8)
    return signed(np.sort(np.partition(words, k - 1)[:k] if k < len(words) else words).tobytes())


def signed(data: bytes) -> int:
    """The XXH64 of data as a signed number."""
    return (xxhash.xxh64_intdigest(data) ^ 1 << 63) - (1 << 63)


def with_sketch(blocks: DataFrame, average: int, extra: bool = False, least: int | None = None) -> DataFrame:
    """blocks (with data) and their sketch."""
    eighths, least = extent(average, extra), average - 1024 if least is None else least
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema) + ", sketch long"
    at = blocks.columns.index("data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sketch(d.as_py(), eighths, least) for d in batch.column(at)], pa.int64())], names=[*batch.schema.names, "sketch"])

    return blocks.transform(mapped, run, schema)


def similar_blocks(sketched: DataFrame, min_distance: int = 0) -> DataFrame:
    """Blocks with the first block of equal sketch and length and other content; offsets of one stream stay apart.

    The first block of a group is the only one to look at. A reference leads back, and a block too near to the first one
    is in its stream, so whatever stands between them is nearer still; a block equal to the first one is no new block.
    """
    first = sketched.groupBy("sketch", "length").agg(F.min(F.struct("stream_id", "block_no", "offset", "cksum")).alias("o"))
    found = sketched.select("stream_id", "block_no", "offset", "length", "cksum", "sketch").join(first, ["sketch", "length"])
    apart = (F.col("o.stream_id") != F.col("stream_id")) | (F.abs(F.col("offset") - F.col("o.offset")) > min_distance)
    found = found.where((F.col("o.cksum") != F.col("cksum")) & apart)
    return found.select("stream_id", "block_no", "length", F.col("o.stream_id").alias("ref_stream"), F.col("o.block_no").alias("ref_block"))
