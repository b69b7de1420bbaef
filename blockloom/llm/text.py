"""Vectorised word and shingle arithmetic over Arrow string batches.

A batch is cut into slices of bounded text size, so the temporaries of one slice stay small however long the
documents of a batch are; a single document longer than the bound makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CODE = mix(np.arange(1, 257, dtype=np.uint64) * MULT) | np.uint64(1)
FOLDED = CODE.copy()
FOLDED[65:91] = CODE[97:123]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least, kept for the next call."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = []
        for b in (BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def forget() -> None:
    """Drops the powers that are kept; a later call makes them anew."""
    _powers.clear()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive slices; nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each document (one entry more than documents).

    A word is a longest run of bytes other than space and \\t to \\r, and never spans two documents.
    """
    word = ~SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    before = np.empty(len(raw) + 1, bool)
    before[0], before[1:] = False, word
    after = np.empty(len(raw) + 1, bool)
    after[-1], after[:-1] = False, word
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = CODE) -> np.ndarray:
    """A 64-bit hash of each word's bytes from one prefix sum of a polynomial over the slice."""
    power, inverse = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(code[raw] * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * MULT)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive words; runs over document ends are the caller's to drop."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out *= BASE
        out += words[k : k + len(out)]
    return mix(out)


def shingles(raw: np.ndarray, off: np.ndarray, n: int, code: np.ndarray = FOLDED) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its n-word shingles.

    With fewer than n words the whole sequence is the one shingle; without words the set is empty.
    """
    starts, ends, first = bounds(raw, off)
    words = word_hashes(raw, starts, ends, code)
    grams = window_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(window_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur at least twice."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    mark = np.zeros(len(keys), bool)
    mark[order[1:][same]] = True
    mark[order[:-1][same]] = True
    return mark


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Marks the positions below size that lie in a window of n from one of the starts, which differ."""
    step = np.zeros(size + n + 1, np.int32)
    step[starts] += 1
    step[starts + n] -= 1
    return np.cumsum(step[:size]) > 0
