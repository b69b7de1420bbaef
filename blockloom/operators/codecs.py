"""Codecs, digests, the filter pipeline, and encoding of chunks with all of them."""

from __future__ import annotations

import bz2
import hashlib
import hmac
import lzma
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from blockloom.operators import delta, digests
from blockloom.shared import BATCH_BYTES, mapped


@dataclass(frozen=True)
class Codec:
    """used names what really runs where a codec has a substitute."""

    used: str
    encode: Callable[[bytes, int], bytes]
    decode: Callable[[bytes, int], bytes]


def _lz4() -> Codec:
    return Codec("lz4", lambda d, level: pa.compress(d, codec="lz4_raw", asbytes=True), lambda d, n: pa.decompress(d, n, codec="lz4_raw", asbytes=True))


def _deflate(d: bytes, level: int) -> bytes:
    c = zlib.compressobj(min(level, 9), zlib.DEFLATED, -15)
    return c.compress(d) + c.flush()


#: The bytes of history that the presets of lzma keep.
HISTORY = (1 << 18, 1 << 20, 1 << 21, 1 << 22, 1 << 22, 1 << 23, 1 << 23, 1 << 24, 1 << 25, 1 << 26)


def _lzma(d: bytes, level: int) -> bytes:
    """d by a preset, with no more history than d fills: an encoder clears tables of its history's size for each chunk."""
    level = min(level, 9)
    history = min(HISTORY[level], max(4096, 1 << max(0, len(d) - 1).bit_length()))
    return lzma.compress(d, filters=[{"id": lzma.FILTER_LZMA2, "preset": level, "dict_size": history}])


CODECS = {
    "none": Codec("none", lambda d, level: d, lambda d, n: d),
    "lz4": _lz4(),
    "lzfx": _lz4(),
    "zlib": Codec("zlib", _deflate, lambda d, n: zlib.decompress(d, -15)),
    "bzip2": Codec("bzip2", lambda d, level: bz2.compress(d, max(1, min(level, 9))), lambda d, n: bz2.decompress(d)),
    "lzma": Codec("lzma", _lzma, lambda d, n: lzma.decompress(d)),
    "lzmaMt": Codec("lzma", _lzma, lambda d, n: lzma.decompress(d)),
}
#: Bit formats without a Python library are replaced, and the output says so: context mixing and block sorting.
CODECS |= {"ppmd": Codec("lzma", CODECS["lzma"].encode, CODECS["lzma"].decode), "libbsc": Codec("bzip2", CODECS["bzip2"].encode, CODECS["bzip2"].decode)}

DIGESTS: dict[str, tuple[int, Callable[[bytes], bytes]]] = {
    "SHA256": (32, lambda d: hashlib.sha256(d).digest()), "SHA512": (64, lambda d: hashlib.sha512(d).digest()),
    "KECCAK256": (32, lambda d: hashlib.sha3_256(d).digest()), "KECCAK512": (64, lambda d: hashlib.sha3_512(d).digest()),
    "BLAKE256": (32, lambda d: hashlib.blake2b(d, digest_size=32).digest()), "BLAKE512": (64, lambda d: hashlib.blake2b(d).digest()),
    "CRC64": (8, lambda d: digests.crc64(d).to_bytes(8, "big")),
}


def mac(data: bytes, key: bytes, digest: str = "SHA256") -> bytes:
    """A keyed digest: BLAKE's own keyed mode, else HMAC."""
    if digest.startswith("BLAKE"):
        return hashlib.blake2b(data, key=key[:64], digest_size=DIGESTS[digest][0]).digest()
    return hmac.new(key, data, {"SHA256": "sha256", "SHA512": "sha512", "KECCAK256": "sha3_256", "KECCAK512": "sha3_512"}[digest]).digest()


LZP_LEAST = 128


def windows(x: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` bytes of x that stand together, made from those of half as many and of single bytes."""
    grown, width, power = x.astype(np.uint64), 1, np.uint64(0x9E3779B97F4A7C15)
    for bit in bin(size)[3:]:
        grown = grown[:-width] * power + grown[width:]
        width, power = 2 * width, power * power
        if bit == "1":
            grown = grown[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[width:].astype(np.uint64)
            width, power = width + 1, power * np.uint64(0x9E3779B97F4A7C15)
    return grown * np.uint64(0xD6E8FEB86659FD93)


def lzp_encode(data: bytes, least: int = LZP_LEAST) -> bytes | None:
    """Repeats of at least `least` bytes as (literals, place, length), the first four bytes ahead; None if no gain.

    The place predicted is where the `least` bytes that follow stood last, so no shorter repeat hides a longer one.
    """
    if len(data) < least + 16:
        return None
    x = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        key = windows(x, least)
    # sorted with the place in the low bits, which orders equal windows by place
    low = np.uint64((1 << len(key).bit_length()) - 1)
    key = np.sort(key & ~low | np.arange(len(key), dtype=np.uint64))
    again = np.flatnonzero((key[1:] ^ key[:-1]) <= low)
    if not len(again):
        return None
    at, was = (key[again + 1] & low).astype(np.int64), (key[again] & low).astype(np.int64)
    order = np.argsort(at)
    at, was = at[order], was[order]
    out, literal, k = [data[:4]], 4, int(np.searchsorted(at, 4))
    while k < len(at):
        i, j = int(at[k]), int(was[k])
        if data[j : j + least] != data[i : i + least]:
            k += 1
            continue
        n, step = least, 4096
        while i + n < len(data):  # as long as it goes on, step by step
            differ = np.flatnonzero(x[i + n : i + n + step] != x[j + n : j + n + min(step, len(x) - i - n)])
            if len(differ):
                n += int(differ[0])
                break
            n = min(n + step, len(data) - i)
            step *= 2
        out += [(i - literal).to_bytes(4, "little"), data[literal:i], j.to_bytes(4, "little"), n.to_bytes(4, "little")]
        literal = i + n
        k = int(np.searchsorted(at, literal))
    out += [(len(data) - literal).to_bytes(4, "little"), data[literal:]]
    joined = b"".join(out)
    return joined if len(joined) < len(data) else None


def lzp_decode(data: bytes) -> bytes:
    out, at = bytearray(data[:4]), 4
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out += data[at + 4 : at + 4 + n]
        at += 4 + n
        if at < len(data):
            j, n = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
            part = bytes(out[j : j + n])
            out += (part * -(-n // len(part)))[:n]  # a repeat may reach into itself
            at += 8
    return bytes(out)


def call_encode(data: bytes, back: bool = False) -> bytes:
    """The operands of x86 calls and jumps (E8, E9) as absolute addresses, or back."""
    out, i = bytearray(data), 0
    while i + 5 <= len(out):
        if out[i] in (0xE8, 0xE9) and out[i + 4] in (0, 0xFF):
            v = int.from_bytes(out[i + 1 : i + 5], "little")
            low = (v - i if back else v + i) & 0xFFFFFF
            out[i + 1 : i + 4] = low.to_bytes(3, "little")
            i += 5
        else:
            i += 1
    return bytes(out)


def x86_block(data: bytes) -> bool:
    """Whether bytes look like x86 code: moves above the average, zeros above twice it, and more than six calls."""
    if not data:
        return False
    mean = len(data) / 256
    return data.count(0x8B) > mean and data.count(0) > 2 * mean and data.count(0xE8) > 6


#: In the order of encoding; each gives None where it does not apply.
FILTERS: dict[str, tuple[Callable[[bytes], bytes | None], Callable[[bytes], bytes]]] = {
    "x86": (lambda d: call_encode(d) if x86_block(d) else None, lambda d: call_encode(d, True)),
    "lzp": (lzp_encode, lzp_decode),
    "delta": (delta.series_encode, delta.series_decode),
}


def encode_chunk(data: bytes, codec: str, level: int = 6, filters: tuple[str, ...] = (), span: int = 50, strides: tuple[int, ...] = (2, 4, 8)) -> tuple[bytes, str, list[str]]:
    """Encoded bytes, the codec that ran ("raw" where nothing shrank) and the filters that applied.

    span: the bytes that an arithmetic series must exceed to be worth its header.
    """
    return squeezed(data, *through_filters(data, filters, span, strides), codec, level)


def through_filters(data: bytes, filters: tuple[str, ...], span: int, strides: tuple[int, ...]) -> tuple[bytes, list[str]]:
    """data after those of the filters that apply, and their names."""
    body, applied = data, []
    for name in (f for f in FILTERS if f in filters):
        made = delta.series_encode(body, strides, span) if name == "delta" else FILTERS[name][0](body)
        if made is not None:
            body = made
            applied.append(name)
    return body, applied


def squeezed(data: bytes, body: bytes, applied: list[str], codec: str, level: int) -> tuple[bytes, str, list[str]]:
    out = CODECS[codec].encode(body, level)
    if len(out) >= len(data):
        return data, "raw", []
    return len(body).to_bytes(4, "little") + out, CODECS[codec].used, applied


def decode_chunk(data: bytes, used: str, applied: list[str]) -> bytes:
    if used == "raw":
        return data
    body = CODECS[used].decode(data[4:], int.from_bytes(data[:4], "little"))
    for name in reversed(applied):
        body = FILTERS[name][1](body)
    return body


ENCODED = "chunk_no long, codec_requested string, codec_used string, filters array<string>, raw_length long, data binary, digest string, crc long, version int"


def encoded(chunks: DataFrame, codec: Column, level: int = 6, filters: tuple[str, ...] = (), digest: str = "SHA256", spans: dict[str, int] | None = None, strides: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """chunks (stream_id, chunk_no, data) as encoded chunks with the digest of the original and a CRC of the result.

    spans: for each codec the bytes that an arithmetic series must exceed. codec may be an array of names: a chunk then
    gives a row for each, its filters run once, and codecs with the same substitute share what it made.
    """
    kind = chunks.schema["stream_id"].dataType.simpleString()
    several = isinstance(chunks.select(codec).schema[0].dataType, ArrayType)

    def made_of(data: bytes, names: list[str]) -> Iterator[tuple]:
        bodies, outs, want = {}, {}, DIGESTS[digest][1](data).hex()
        for c in names:
            span, used = (spans or {}).get(c, 50), CODECS[c].used
            if span not in bodies:
                bodies[span] = through_filters(data, filters, span, strides)
            if (span, used) not in outs:
                out = squeezed(data, *bodies[span], c, level)
                outs[span, used] = *out, zlib.crc32(out[0])
            out, used, applied, crc = outs[span, used]
            yield c, used, applied, len(data), out, want, crc, 10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = [], [], 0
            for k, (d, c) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                names = c.as_py() if several else [c.as_py()]
                made = list(made_of(d.as_py(), names))
                at += [k] * len(made)
                rows += made
                held += sum(len(r[4]) for r in made)
                if held > BATCH_BYTES:
                    yield written(batch, at, rows)
                    at, rows, held = [], [], 0
            if rows:
                yield written(batch, at, rows)

    def written(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int32())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), *columns], names=["stream_id", "chunk_no", "codec_requested", "codec_used", "filters", "raw_length", "data", "digest", "crc", "version"])

    return mapped(chunks.select("stream_id", "chunk_no", "data", codec.alias("codec")), run, f"stream_id {kind}, {ENCODED}")


def decoded(encoded_chunks: DataFrame, digest: str = "SHA256", keep_data: bool = True) -> DataFrame:
    """stream_id, chunk_no, data and error: what a CRC, the decoder or the digest found wrong, data then being null.

    A row with the same bytes, codec and filters as the last one of these is not decoded anew. Without keep_data there is
    the length of data in its place, and no decoded bytes leave the kernel.
    """
    kind = encoded_chunks.schema["stream_id"].dataType.simpleString()

    def judged(last: dict[tuple, tuple[bytes, bytes, str]], used: str, applied: list[str], raw: bytes, want: str, crc: int) -> tuple[bytes | None, str | None]:
        if zlib.crc32(raw) != crc:
            return None, "crc"
        how = used, *applied
        if how not in last or last[how][0] != raw:
            try:
                body = decode_chunk(raw, used, applied)
            except Exception as e:  # any damage a decoder can meet
                return None, f"decode: {type(e).__name__}"
            last[how] = raw, body, DIGESTS[digest][1](body).hex()
        _, body, have = last[how]
        return (body, None) if have == want else (None, "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[tuple, tuple[bytes, bytes, str]] = {}
        for batch in batches:
            out, errors, held, start = [], [], 0, 0
            for row in zip(*batch.columns[2:], strict=True):
                body, error = judged(last, *(x.as_py() for x in row))
                out.append(body if keep_data or body is None else len(body))
                errors.append(error)
                held += len(body) if keep_data and body is not None else 0
                if held > BATCH_BYTES:
                    yield written(batch, start, out, errors)
                    start += len(out)
                    out, errors, held = [], [], 0
            if out:
                yield written(batch, start, out, errors)

    def written(batch: pa.RecordBatch, start: int, out: list, errors: list[str | None]) -> pa.RecordBatch:
        keys = (batch.column(i).slice(start, len(out)) for i in range(2))
        return pa.RecordBatch.from_arrays([*keys, pa.array(out, pa.binary() if keep_data else pa.int64()), pa.array(errors, pa.string())], names=["stream_id", "chunk_no", "data" if keep_data else "length", "error"])

    rows = encoded_chunks.select("stream_id", "chunk_no", "codec_used", "filters", "data", "digest", "crc")
    return mapped(rows, run, f"stream_id {kind}, chunk_no long, {'data binary' if keep_data else 'length long'}, error string")


def usage(encoded_chunks: DataFrame) -> DataFrame:
    """Chunks and bytes by codec asked for and used."""
    return encoded_chunks.groupBy("codec_requested", "codec_used").agg(F.count("*").alias("n_chunks"), F.sum("raw_length").alias("raw_bytes"), F.sum(F.octet_length("data")).alias("encoded_bytes"))


def byte_histogram(streams: DataFrame) -> DataFrame:
    """byte, n over all streams: counted batch by batch, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(256, np.int64)
            for d in batch.column(0):
                if d.is_valid and len(d.as_buffer()):
                    n += np.bincount(np.frombuffer(d.as_buffer(), np.uint8), minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(n)], names=["byte", "n"])

    return streams.select("data").transform(mapped, run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).where("n > 0")


def filter_checks(streams: DataFrame) -> DataFrame:
    """stream_id, filter, applied, and whether the inverse gives the stream back, for every filter and byte transform."""
    kind = streams.schema["stream_id"].dataType.simpleString()
    extra = {"zero_runs": (delta.zero_encode, delta.zero_decode), "transpose": (lambda d: delta.transpose(d, 8), lambda d: delta.transpose(d, 8, back=True))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [d.as_py() for d in batch.column(1)]
            for name, (encode, decode) in (FILTERS | extra).items():
                made = [encode(d) for d in data]
                same = [m is None or decode(m) == d for m, d in zip(made, data, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(data)), pa.array([m is not None for m in made]), pa.array(same)], names=["stream_id", "filter", "applied", "restored"])

    return streams.select("stream_id", "data").transform(mapped, run, f"stream_id {kind}, filter string, applied boolean, restored boolean")


#: The filters of a subtype of content, tried in this order.
BY_SUBTYPE = {"exe32": ("x86",), "exe64": ("x86",), "wav": ("delta",), "bmp": ("delta",), "pnm": ("delta",), "tar": ("lzp",)}


def filtered(streams: DataFrame, by_subtype: dict[str, tuple[str, ...]] = BY_SUBTYPE) -> DataFrame:
    """streams (stream_id, subtype, data) through the first filter of their subtype that applies: stream_id, filter_name, data.

    filter_name is null where none applied, data then being as it was. A null subtype has no filter; null data stays null.
    """
    kind = streams.schema["stream_id"].dataType.simpleString()

    def one(subtype: str | None, data: bytes | None) -> tuple[str | None, bytes | None]:
        for name in by_subtype.get(subtype, ()) if data is not None else ():
            made = FILTERS[name][0](data)
            if made is not None:
                return name, made
        return None, data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(t.as_py(), d.as_py()) for t, d in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in out], pa.string()), pa.array([d for _, d in out], pa.binary())], names=["stream_id", "filter_name", "data"])

    return streams.select("stream_id", "subtype", "data").transform(mapped, run, f"stream_id {kind}, filter_name string, data binary")


def unfiltered(made: DataFrame) -> DataFrame:
    """stream_id and data of what filtered() made, as it was before."""
    kind = made.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, data = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            back = [FILTERS[n][1](d) if n else d for n, d in zip(names, data, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], names=["stream_id", "data"])

    return made.select("stream_id", "filter_name", "data").transform(mapped, run, f"stream_id {kind}, data binary")


def keyed_macs(streams: DataFrame, key: bytes, digest: str = "SHA256") -> DataFrame:
    """stream_id and its keyed digest in hex: an expression for SHA-2, an Arrow kernel for the others."""
    if digest in ("SHA256", "SHA512"):
        return streams.select("stream_id", digests.hmac(F.coalesce("data", F.lit(b"").cast("binary")), key, int(digest[3:])).alias("mac"))
    kind = streams.schema["stream_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mac(d.as_py() or b"", key, digest).hex() for d in batch.column(1)])], names=["stream_id", "mac"])

    return streams.select("stream_id", "data").transform(mapped, run, f"stream_id {kind}, mac string")
