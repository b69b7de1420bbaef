"""Digests of blocks as SQL expressions, and CRC-64, for which Spark has none."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the polynomial of ECMA-182, reflected.
POLYNOMIAL = 0xC96C5795D7870F42
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes from which a value is cut into lanes that numpy works on side by side.
LANES_FROM = 2048


def _table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        out = np.where(out & np.uint64(1), out >> np.uint64(1) ^ np.uint64(POLYNOMIAL), out >> np.uint64(1))
    return out


TABLE = _table()
STEPS = TABLE.tolist()


def _fed(state: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The registers after the bytes of each row of columns."""
    for column in columns.T:
        state = TABLE[(state ^ column).astype(np.uint8)] ^ state >> np.uint64(8)
    return state


def crc64(data: bytes) -> int:
    """CRC-64 with the reflected polynomial of ECMA-182, all ones before and after."""
    x, lanes = np.frombuffer(data, np.uint8), 1
    if len(x) >= LANES_FROM:
        lanes = 1 << (len(x).bit_length() // 2)
    each = len(x) // lanes if lanes > 1 else 0
    head = len(x) - each * lanes
    state = int(ONES)
    for b in data[:head]:
        state = STEPS[(state ^ b) & 255] ^ state >> 8
    if each:
        ends = _fed(np.zeros(lanes, np.uint64), x[head:].reshape(lanes, each).astype(np.uint64)).tolist()
        # a register after so many zero bytes is the sum of what its bits become
        bits = _fed(np.uint64(1) << np.arange(64, dtype=np.uint64), np.zeros((64, each), np.uint64)).tolist()
        for end in ends:
            moved = 0
            while state:
                low = state & -state
                moved ^= bits[low.bit_length() - 1]
                state ^= low
            state = moved ^ end
    return state ^ int(ONES)


#: Digests that Spark computes itself; the fast ones have to be confirmed by a comparison of lengths and bytes.
EXPRESSIONS = {
    "SHA256": lambda c: F.sha2(c, 256), "SHA512": lambda c: F.sha2(c, 512), "SHA1": F.sha1, "MD5": F.md5,
    "XXH64": lambda c: F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0")), "CRC32": lambda c: F.lower(F.lpad(F.hex(F.crc32(c)), 8, "0")),
}


def digest(data: Column, name: str = "SHA256") -> Column:
    """The digest of a binary column as lower-case hex."""
    if name not in EXPRESSIONS:
        raise ValueError(f"no digest {name} as an expression: {', '.join(EXPRESSIONS)}")
    return EXPRESSIONS[name](data)


def hmac(data: Column, key: bytes, bits: int = 256) -> Column:
    """HMAC with SHA-2 by its definition: two nested digests."""
    import hashlib

    size = 64 if bits == 256 else 128
    key = key if len(key) <= size else hashlib.new(f"sha{bits}", key).digest()
    inner, outer = (bytes(b ^ pad for b in key.ljust(size, b"\0")) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), data), bits))), bits)
