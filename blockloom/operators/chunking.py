"""Cutting streams into blocks: fixed sizes with SQL functions, content-defined cuts in an Arrow kernel.

A stream that is too long for one row comes as consecutive slices; see slice_cuts().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators import digests
from blockloom.shared import mapped

# Fixed values of the cut test.
MULTIPLIER = 153191
WINDOW = 16
MASK = 1023
TAPS = 0xBFE6B8A5BF378D83
MAX_BLOCK = 128 << 10
MAX_BLOCK_GLOBAL = 64 << 10


def fixed_blocks(streams: DataFrame, size: int, keep_data: bool = False, digest: str = "SHA256", carried: tuple[str, ...] = ()) -> DataFrame:
    """stream_id, block_no, offset, length, cksum (and data) of blocks of one size; the last is shorter.

    digest: one of digests.EXPRESSIONS; a fast one is no proof that blocks are equal. carried: columns of the stream that
    each of its blocks gets too.
    """
    rows = streams.where(F.octet_length("data") > 0)
    rows = rows.withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"CAST((octet_length(data) - 1) div {size} AS BIGINT)"))))
    rows = rows.withColumn("block", F.substring(F.col("data"), (F.col("block_no") * size + 1).cast("int"), F.lit(size)))
    return described(rows.withColumn("offset", F.col("block_no") * size), keep_data, digest, carried)


def described(rows: DataFrame, keep_data: bool, digest: str = "SHA256", carried: tuple[str, ...] = ()) -> DataFrame:
    columns = ["stream_id", "block_no", "offset", F.octet_length("block").cast("long").alias("length"), digests.digest(F.col("block"), digest).alias("cksum")]
    return rows.select(*columns, *([F.col("block").alias("data")] if keep_data else []), *carried)


def chunks(streams: DataFrame, size: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of one size, the unit of parallel work: stream_id, chunk_no, file_offset, data, and what is carried along."""
    out = fixed_blocks(streams, size, keep_data=True, carried=carried)
    return out.select("stream_id", F.col("block_no").alias("chunk_no"), F.col("offset").alias("file_offset"), "data", *carried)


def leaving_table() -> np.ndarray:
    """For each byte value, what it adds to the cut test when it leaves the window, modulo the mask."""
    power, weight = 1, 0
    for i in range(WINDOW):
        if TAPS >> i & 1:
            weight += power
        power = power * MULTIPLIER & MASK
    return (1 + np.arange(256, dtype=np.int64) * weight) & MASK


LEAVING = leaving_table()


def cut_candidates(data: np.ndarray) -> np.ndarray:
    """Positions whose last 17 bytes pass the cut test, whatever stands before them."""
    n = len(data)
    if n <= WINDOW:
        return np.zeros(0, np.int64)
    x = data.astype(np.int64)
    rolling = np.zeros(n - WINDOW, np.int64)
    power = 1
    for k in range(WINDOW):
        rolling += x[WINDOW - k : n - k] * power
        power = power * MULTIPLIER & MASK
    return np.flatnonzero(((rolling & MASK) ^ LEAVING[data[: n - WINDOW]]) == 0) + WINDOW


def choose_cuts(candidates: np.ndarray, n: int, least: int, most: int) -> list[int]:
    """Ends of the blocks of a stream of n bytes: the first candidate at least `least` on, or `most`, again and again."""
    ends, last = [], 0
    while n - last > least:
        at = np.searchsorted(candidates, last + least - 1)
        end = min(int(candidates[at]) if at < len(candidates) else n, last + most - 1)
        if end >= n - WINDOW:
            break
        last = end + 1
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def limits(block_bits: int, whole: bool) -> tuple[int, int]:
    """Least and most bytes of a content-defined block."""
    return (1 << (11 + block_bits)) - 1024, MAX_BLOCK_GLOBAL if whole and block_bits < 3 else MAX_BLOCK


def content_blocks(streams: DataFrame, block_bits: int = 2, whole: bool = False, keep_data: bool = False, least: int | None = None, most: int | None = None) -> DataFrame:
    """stream_id, block_no, offset, length, cksum (and data) of content-defined blocks."""
    low, high = limits(block_bits, whole)
    low, high = least or low, most or high
    kind = streams.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                raw = data.as_buffer() if data.is_valid else b""
                x = np.frombuffer(raw, np.uint8) if len(raw) else np.zeros(0, np.uint8)
                ends = choose_cuts(cut_candidates(x), len(x), low, high)
                if not ends:
                    continue
                starts = [0, *ends[:-1]]
                blocks = [x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(ends), batch.schema.field(0).type), pa.array(range(len(ends)), pa.int64()), pa.array(starts, pa.int64()), pa.array(blocks, pa.binary())], names=["stream_id", "block_no", "offset", "block"])

    rows = streams.select("stream_id", "data").transform(mapped, run, f"stream_id {kind}, block_no long, offset long, block binary")
    return described(rows, keep_data)


def candidate_sums(streams: DataFrame) -> DataFrame:
    """Number and sum of the cut candidates of each stream."""
    kind = streams.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut_candidates(np.frombuffer(d.as_buffer(), np.uint8)) if d.is_valid and len(d.as_buffer()) else np.zeros(0, np.int64) for d in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([int(f.sum()) for f in found], pa.int64())], names=["stream_id", "n_cuts", "pos_sum"])

    return streams.select("stream_id", "data").transform(mapped, run, f"stream_id {kind}, n_cuts long, pos_sum long")


def last_cuts(streams: DataFrame, window: int = MAX_BLOCK) -> DataFrame:
    """stream_id and last_cut, the last cut candidate in the last `window` bytes, or -1.

    A stream without end is read up to there, and goes on from there with what arrives later.
    """
    kind = streams.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d in batch.column(1):
                x = np.frombuffer(d.as_buffer(), np.uint8) if d.is_valid and len(d.as_buffer()) else np.zeros(0, np.uint8)
                skip = max(0, len(x) - window - WINDOW)  # the test looks back
                found = cut_candidates(x[skip:]) + skip
                found = found[found >= len(x) - window]
                out.append(int(found[-1]) if len(found) else -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], names=["stream_id", "last_cut"])

    return streams.select("stream_id", "data").transform(mapped, run, f"stream_id {kind}, last_cut long")


def slice_cuts(slices: DataFrame, block_bits: int = 2, whole: bool = True) -> DataFrame:
    """stream_id, block_no, offset, length of streams given as slices (stream_id, offset, size, before, data).

    before holds the 16 bytes that precede the slice, so candidates are found slice by slice in parallel; only the
    choice among them, eight bytes for about a thousand of data, goes stream by stream.
    """
    low, high = limits(block_bits, whole)
    kind = slices.schema["stream_id"].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, offset, size, before, data in zip(*batch.columns, strict=True):
                head = before.as_py() or b""
                at = cut_candidates(np.frombuffer(head + data.as_py(), np.uint8)) + offset.as_py() - len(head)
                at = np.append(at, -1)  # a slice without a candidate still tells the stream's size
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(at), batch.schema.field(0).type), pa.array([size.as_py()] * len(at), pa.int64()), pa.array(at, pa.int64())], names=["stream_id", "size", "at"])

    def chosen(table: pa.Table) -> pa.Table:
        at = np.unique(table["at"].to_numpy())
        ends = choose_cuts(at[at >= 0], int(table["size"][0].as_py()), low, high)
        starts = [0, *ends[:-1]]
        return pa.table({"stream_id": pa.array([table["stream_id"][0].as_py()] * len(ends), table.schema.field("stream_id").type), "block_no": pa.array(range(len(ends)), pa.int64()), "offset": pa.array(starts[: len(ends)], pa.int64()), "length": pa.array([b - a for a, b in zip(starts, ends, strict=False)], pa.int64())})

    rows = slices.select("stream_id", "offset", "size", "before", "data").transform(mapped, found, f"stream_id {kind}, size long, at long")
    return rows.groupBy("stream_id").applyInArrow(chosen, f"stream_id {kind}, block_no long, offset long, length long")
