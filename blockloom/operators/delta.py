"""Differences: arithmetic series in columns and bytes, zero runs, and patches between similar blocks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.shared import mapped

SERIES_BLOCK = 4096
HEADER = struct.Struct("<BI")
SERIES = struct.Struct("<BIQQ")
ZERO_MAX = 32767


def arithmetic_runs(df: DataFrame, key: str, value: Column, span: int = 4096) -> DataFrame:
    """Arithmetic series of value in key order: chunk, run, start, step, n. Chunks of span keys are independent.

    A run goes on as long as the difference stays; the first row of a chunk is a run of its own.
    """
    rows = df.select(F.expr(f"{key} div {span}").alias("chunk"), F.col(key).alias("_k"), value.cast("long").alias("v"))
    order = Window.partitionBy("chunk").orderBy("_k", "v")
    rows = rows.withColumn("d", F.col("v") - F.lag("v").over(order))
    rows = rows.withColumn("_new", (~F.col("d").eqNullSafe(F.lag("d").over(order)) | F.col("d").isNull()).cast("int"))
    rows = rows.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("chunk", "run").agg(F.min_by("v", F.struct("_k", "v")).alias("start"), F.coalesce(F.max("d"), F.lit(0)).alias("step"), F.count("*").alias("n"))


def expand_runs(runs: DataFrame) -> DataFrame:
    """The values that runs stand for: chunk, run, i, v."""
    return runs.select("chunk", "run", "start", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("chunk", "run", "i", (F.col("start") + F.col("i") * F.col("step")).alias("v"))


def value_runs(df: DataFrame, part: list[str], order: list[str], test: Column) -> DataFrame:
    """Longest runs of rows that pass a test, within part: part columns, first position, n."""
    w = Window.partitionBy(*part).orderBy(*order)
    rows = df.withColumns({"_pos": F.row_number().over(w), "_t": test})
    rows = rows.withColumn("_g", F.col("_pos") - F.sum(F.col("_t").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_t")
    return rows.groupBy(*part, "_g").agg(F.min("_pos").alias("first_pos"), F.count("*").alias("n")).drop("_g")


def words(data: bytes, stride: int) -> np.ndarray:
    """Little-endian numbers of stride bytes; bytes over are left out."""
    n = len(data) // stride
    if stride in (1, 2, 4, 8):
        return np.frombuffer(data, f"<u{stride}", n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :stride] = np.frombuffer(data, np.uint8, n * stride).reshape(n, stride)
    return out.view("<u8").ravel()


def steps(data: bytes, stride: int) -> np.ndarray:
    """The differences of words, modulo what a word holds."""
    v = words(data, stride)
    d = v[1:] - v[:-1]
    return d if d.itemsize == stride else d & np.uint64((1 << (8 * stride)) - 1)


def may_have_series(data: bytes, stride: int, least: int) -> bool:
    """False where no piece of data, cut between its words, has a series of more than `least` bytes."""
    alike = least // stride - 1  # steps of such a series that are the same as the one before
    if alike < 1:
        return True
    d = steps(data, stride)
    at = np.flatnonzero(d[1:] == d[:-1])
    return len(at) >= alike and bool((at[alike - 1 :] - at[: len(at) - alike + 1] == alike - 1).any())


def series(data: bytes, stride: int, least: int) -> list[tuple[int, int]]:
    """First and end word of the arithmetic series of more than `least` bytes, in order and apart."""
    if len(data) // stride < 3:
        return []
    d = steps(data, stride)
    edges = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1], [True]]))
    a, b = edges[:-1], edges[1:]
    long = (b + 1 - a) * stride > least
    out, free = [], 0
    for a, b in zip(a[long].tolist(), b[long].tolist(), strict=True):
        a = max(a, free)  # words a..b form one series
        if (b + 1 - a) * stride > least:
            out.append((a, b + 1))
            free = b + 1
    return out


def size_with(found: list[tuple[int, int]], n: int, stride: int) -> int:
    """Bytes that n bytes take when their series stand as such."""
    return n - sum((b - a) * stride for a, b in found) + len(found) * (SERIES.size + HEADER.size) + HEADER.size


def encoded_size(data: bytes, stride: int, least: int) -> int:
    return size_with(series(data, stride, least), len(data), stride)


def series_encode(data: bytes, strides: tuple[int, ...] = (2, 4, 8), least: int = 50) -> bytes | None:
    """data with its series as (length, start, step), block by block at the best stride; None if that is not shorter.

    What stands between series is one piece, however many blocks it fills.
    """
    out, last = [], 0
    likely = [s for s in strides if SERIES_BLOCK % s or may_have_series(data, s, least)]
    for at in range(0, len(data) if likely else 0, SERIES_BLOCK):
        part = data[at : at + SERIES_BLOCK]
        tried = {s: series(part, s, least) if s in likely else [] for s in strides}
        if not any(tried.values()):
            continue
        stride = min(strides, key=lambda s: size_with(tried[s], len(part), s))
        v, mask = words(part, stride), (1 << (8 * stride)) - 1
        for a, b in tried[stride]:
            if at + a * stride > last:
                out += [HEADER.pack(0, at + a * stride - last), data[last : at + a * stride]]
            out.append(SERIES.pack(stride, b - a, int(v[a]), int(v[a + 1]) - int(v[a]) & mask))
            last = at + b * stride
    if not out:
        return None
    if last < len(data):
        out += [HEADER.pack(0, len(data) - last), data[last:]]
    joined = b"".join(out)
    return joined if len(joined) < len(data) else None


def series_decode(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        stride = data[at]
        if not stride:
            n = HEADER.unpack_from(data, at)[1]
            at += HEADER.size
            out.append(data[at : at + n])
            at += n
            continue
        _, n, start, step = SERIES.unpack_from(data, at)
        at += SERIES.size
        v = np.uint64(start) + np.arange(n, dtype=np.uint64) * np.uint64(step)
        out.append(v.astype("<u8").view(np.uint8).reshape(n, 8)[:, :stride].tobytes())
    return b"".join(out)


def zero_encode(data: bytes) -> bytes:
    """Runs of bytes as (zeros, literals, bytes): zeros are counted, ZERO_MAX at a time."""
    x = np.frombuffer(data, np.uint8)
    zero = np.concatenate([[False], x == 0, [False]])
    edges = np.flatnonzero(zero[1:] != zero[:-1]).reshape(-1, 2).tolist()
    out, last = [], 0
    for a, b in [*edges, [len(x), len(x)]]:
        for s in range(last, a, ZERO_MAX):
            out += [struct.pack("<HH", 0, min(ZERO_MAX, a - s)), data[s : min(a, s + ZERO_MAX)]]
        for s in range(a, b, ZERO_MAX):
            out.append(struct.pack("<HH", min(ZERO_MAX, b - s), 0))
        last = b
    return b"".join(out)


def zero_decode(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        zeros, n = struct.unpack_from("<HH", data, at)
        at += 4
        out += [bytes(zeros), data[at : at + n]]
        at += n
    return b"".join(out)


def transpose(data: bytes, stride: int, back: bool = False) -> bytes:
    """The bytes of rows of stride as columns, or back; bytes over stay at the end."""
    n = len(data) // stride * stride
    x = np.frombuffer(data, np.uint8, n)
    x = x.reshape(stride, -1) if back else x.reshape(-1, stride)
    return x.T.tobytes() + data[n:]


def common(a: np.ndarray, j: int, b: np.ndarray, i: int) -> int:
    """How many bytes from a[j] and b[i] on are the same."""
    n = min(len(a) - j, len(b) - i)
    other = a[j : j + n] != b[i : i + n]
    return int(other.argmax()) if other.any() else n


def diff(old: bytes, new: bytes, word: int = 8, least: int = 16) -> bytes:
    """A patch that makes new from old: copies of old where words of it recur, and the bytes between.

    Words of old at multiples of `word` are looked up at every position of new in numpy, then matches grow both ways. A
    word that stands often is taken at the same position too, and the longer match counts.
    """
    out, at = [], 0
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    if len(a) >= word and len(b) >= word:
        keys = np.frombuffer(old, "<u8", len(old) // 8)
        order = np.argsort(keys, kind="stable")
        rolled = np.zeros(len(b) - 7, np.uint64)
        for k in range(8):
            rolled |= b[k : k + len(rolled)].astype(np.uint64) << np.uint64(8 * k)
        place = np.searchsorted(keys[order], rolled)
        hit = np.flatnonzero(keys[order][np.minimum(place, len(keys) - 1)] == rolled)
        source = order[np.minimum(place, len(keys) - 1)] * 8
        for i in hit.tolist():
            if i < at:
                continue
            j = int(source[i])
            n = common(a, j, b, i)
            if j != i < len(a) and (there := common(a, i, b, i)) > n:
                j, n = i, there
            back = 0
            while back < i - at and back < j and a[j - back - 1] == b[i - back - 1]:
                back += 1
            if n + back >= least:
                out += [HEADER.pack(0, i - back - at), new[at : i - back], HEADER.pack(1, n + back), struct.pack("<I", j - back)]
                at = i + n
    out += [HEADER.pack(0, len(new) - at), new[at:]]
    return b"".join(out)


def patch(old: bytes, delta: bytes) -> bytes:
    out, at = [], 0
    while at < len(delta):
        kind, n = HEADER.unpack_from(delta, at)
        at += HEADER.size
        if kind:
            j = struct.unpack_from("<I", delta, at)[0]
            out.append(old[j : j + n])
            at += 4
        else:
            out.append(delta[at : at + n])
            at += n
    return b"".join(out)


def patches(pairs: DataFrame) -> DataFrame:
    """pairs (stream_id, block_no, old, new) with patch_bytes, applied (new if the patch is no gain) and whether it fits."""
    kind = pairs.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(o.as_py(), n.as_py()) for o, n in zip(batch.column(2), batch.column(3), strict=True)]
            deltas = [diff(o, n) for o, n in made]
            fits = [patch(o, d) == n for (o, n), d in zip(made, deltas, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(n) for _, n in made], pa.int64()), pa.array([len(d) for d in deltas], pa.int64()), pa.array([len(d) < len(n) for d, (_, n) in zip(deltas, made, strict=True)]), pa.array(fits)], names=["stream_id", "block_no", "raw_bytes", "patch_bytes", "used", "fits"])

    return pairs.select("stream_id", "block_no", "old", "new").transform(mapped, run, f"stream_id {kind}, block_no long, raw_bytes long, patch_bytes long, used boolean, fits boolean")


def stride_costs(streams: DataFrame, strides: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8), least: int = 50) -> DataFrame:
    """stream_id, stride and the bytes that series coding at that stride would leave."""
    kind = streams.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column(0), [d.as_py() for d in batch.column(1)]
            for s in strides:
                cost = [sum(encoded_size(d[a : a + SERIES_BLOCK], s, least) for a in range(0, len(d), SERIES_BLOCK)) for d in data]
                yield pa.RecordBatch.from_arrays([keys, pa.array([s] * len(data), pa.int32()), pa.array(cost, pa.int64())], names=["stream_id", "stride", "cost"])

    return streams.select("stream_id", "data").transform(mapped, run, f"stream_id {kind}, stride int, cost long")
