"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Texts are cut where no piece of the vocabulary can cross: before a word-start mark that follows another character, and
around newlines when no piece holds one. The agenda then works on the distinct segments of an Arrow batch at once: each
segment is a row of symbols, each adjacent pair has the score of the piece that it makes, and every step merges the best
pair of each row, the leftmost of equal ones, until no pair makes a piece. Segments longer than ROW symbols use a heap
agenda. Every segment met for the first time is checked against the sentencepiece library, batch by batch, and one whole
text of each batch too; a difference raises.

Defined results: a null text counts as empty; an empty text has the begin and end ids alone; characters outside the
vocabulary become byte pieces, or the unknown id if the model has none; repeated rows are encoded row by row; extra
columns are carried along unless they clash with a result column, which replaces them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.shared import extended, mapped

MARK = "▁"
ROW = 32
#: Bytes of segments and their ids that a Python worker keeps at most, by an estimate, in two halves: those used since the
#: last change of halves, and the ones before, which go at the next.
CACHE = 24 << 20
#: What an entry takes beside its characters and ids.
ENTRY = 240
NONE = np.int32(-1)


class Encoder:
    """The agenda over one model file; the library is only asked for the vocabulary, the checks and decoding."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces that hold a word-start mark after other characters are not supported")
        # a cut between two characters is safe if no piece holds them side by side
        letter, apart = re.compile(r"[^\W\d_]"), ""
        while mixed := {x if letter.match(x) else y for p in pieces for x, y in zip(p, p[1:], strict=False) if x != MARK and bool(letter.match(x)) != bool(letter.match(y))}:
            apart += "".join(sorted(mixed))  # letters that pieces hold beside other characters count as such
            letter = re.compile(rf"[^\W\d_{re.escape(apart)}]")
        lone = not any("\n" in p and len(p) > 1 for p in pieces)
        other = rf"[^{MARK}\n]" if lone else f"[^{MARK}]"
        rest = rf"(?:(?!{letter.pattern}){other})+"
        self.split = re.compile(rf"{MARK}*{letter.pattern}+|{MARK}*{rest}|{MARK}+" + r"|\n" * lone)
        self.newline = sp.encode("\n")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.by_bytes = all(sp.is_byte(i) for i in self.bytes)
        # symbols: pieces keep their ids; single characters without a piece get ids beyond them
        self.symbol = dict(pieces)
        self.names: list[str] = []
        for p in pieces:
            for c in p:
                self.add(c, size)
        self.size = size
        pairs: dict[int, int] = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        keys = np.array(sorted(pairs), np.int64)
        self.pair_of = pairs
        self.keys, self.made = np.append(keys, np.int64(2**62)), np.append(np.array([pairs[int(k)] for k in keys], np.int32), NONE)
        self.score = np.array([sp.get_score(i) for i in range(size)] + [-np.inf], np.float32)
        self.known: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}
        self.held = 0

    def add(self, char: str, size: int) -> int:
        at = self.symbol.get(char)
        if at is None:
            at = self.symbol[char] = size + len(self.names)
            self.names.append(char)
        return at

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or NONE."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def rows(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The agenda for many segments of at most ROW characters at once: their symbols in a row, and how many of each."""
        n, length = len(segments), np.array([len(s) for s in segments])
        width = int(length.max())
        codes = "".join(segments)
        distinct = {c: self.symbol[c] if c in self.symbol else self.add(c, self.size) for c in set(codes)}
        sym = np.full((n, width + 2), NONE, np.int32)  # the last two columns stay empty, for pairs over the end
        sym[:, :width][np.arange(width) < length[:, None]] = np.fromiter(map(distinct.__getitem__, codes), np.int32, len(codes))
        made = self.merges(sym[:, :width], sym[:, 1 : width + 1])
        score = self.score[made]
        place = np.arange(width + 2, dtype=np.int16)
        after, before = np.tile(np.minimum(place + 1, width), (n, 1)), np.tile(place - 1, (n, 1))  # before the first: -1, an empty column
        live, best = np.arange(n), score.argmax(1)
        while True:
            on = made[live, best] >= 0
            live, left = live[on], best[on]
            if not len(live):
                break
            gone = after[live, left]
            right, ahead = after[live, gone], before[live, left]
            sym[live, left] = piece = made[live, left]
            sym[live, gone] = NONE
            score[live, np.minimum(gone, width - 1)] = -np.inf
            made[live, np.minimum(gone, width - 1)] = NONE
            after[live, left], before[live, right] = right, left
            pair = self.merges(np.concatenate([piece, sym[live, ahead]]), np.concatenate([sym[live, right], piece]))
            made[live, left], score[live, left] = pair[: len(live)], self.score[pair[: len(live)]]
            some = ahead >= 0
            made[live[some], ahead[some]] = back = pair[len(live) :][some]
            score[live[some], ahead[some]] = self.score[back]
            best = score[live].argmax(1)
        kept = sym[:, :width] >= 0
        return sym[:, :width][kept], kept.sum(1)

    def heap(self, segment: str) -> list[int]:
        """The agenda for one segment of any length."""
        sym = [self.symbol.get(c, -1) if c in self.symbol else self.add(c, self.size) for c in segment]
        prev, next_ = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        agenda: list[tuple[float, int, int, int, int]] = []

        def put(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (made := self.pair_of.get(sym[a] << 32 | sym[b])) is not None:
                heapq.heappush(agenda, (-float(self.score[made]), a, b, sym[a] << 32 | sym[b], made))

        for i in range(len(sym) - 1):
            put(i, i + 1)
        while agenda:
            _, a, b, pair, made = heapq.heappop(agenda)
            if sym[a] < 0 or next_[a] != b or sym[a] << 32 | sym[b] != pair:
                continue
            sym[a], sym[b] = made, -1
            next_[a] = next_[b]
            if next_[a] >= 0:
                prev[next_[a]] = a
            put(prev[a], a)
            put(a, next_[a])
        return [s for s in sym if s >= 0]

    def ids(self, symbols: list[int]) -> list[int]:
        """Symbols without a piece as their bytes."""
        if max(symbols) < self.size:
            return symbols
        out: list[int] = []
        for s in symbols:
            if s < self.size:
                out.append(s)
            elif self.by_bytes:
                out += [self.bytes[b] for b in self.names[s - self.size].encode()]
            elif not out or out[-1] != self.unk:
                out.append(self.unk)
        return out

    def learn(self, segments: list[str]) -> None:
        """Encodes segments that are not known yet and checks them against the library."""
        segments = sorted(segments, key=len)
        cut = next((i for i, s in enumerate(segments) if len(s) > ROW), len(segments))
        parts, counts, step = [], [], 8192
        for a in range(0, cut, step):
            flat, count = self.rows(segments[a : min(a + step, cut)])
            parts.append(flat)
            counts.append(count)
        for x in map(self.heap, segments[cut:]):
            parts.append(np.array(x, np.int32))
            counts.append(np.array([len(x)]))
        flat, off = np.concatenate(parts), np.cumsum(np.concatenate([[0], *counts])).tolist()
        if flat.max() >= self.size:
            found = [self.ids(flat[a:b].tolist()) for a, b in zip(off, off[1:], strict=False)]
            flat, off = np.array([i for x in found for i in x], np.int32), np.cumsum([0, *map(len, found)]).tolist()
        self.compare(segments, flat, off)
        raw = flat.astype("<u4").tobytes()
        self.keep((s, raw[4 * a : 4 * b]) for s, a, b in zip(segments, off, off[1:], strict=False))

    def keep(self, entries: Iterable[tuple[str, bytes]]) -> None:
        for s, ids in entries:
            self.known[s] = ids
            self.held += ENTRY + len(s) + len(ids)

    def recalled(self, segments: set[str]) -> list[str]:
        """The segments that are not known any more; those of the past half are known again."""
        self.keep((s, self.past[s]) for s in segments if s in self.past)
        return [s for s in segments if s not in self.known]

    def compare(self, segments: list[str], flat: np.ndarray, off: list[int]) -> None:
        """Raises if the library, after a newline, encodes a segment to other ids."""
        skip = len(self.newline)
        theirs = self.sp.encode(["\n" + s for s in segments], num_threads=1)
        if sum(map(len, theirs)) == len(flat) + skip * len(segments):
            both = np.fromiter(chain.from_iterable(theirs), np.int32, len(flat) + skip * len(segments))
            text = np.ones(len(both), bool)
            for k in range(skip):
                text[np.array(off[:-1]) + skip * np.arange(len(segments)) + k] = False
            if np.array_equal(both[text], flat):
                return
        for s, a, b, other in zip(segments, off, off[1:], theirs, strict=False):
            if flat[a:b].tolist() != other[skip:]:
                raise AssertionError(f"the agenda and the library differ on {s!r}")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids with begin and end as little-endian unsigned 32-bit integers."""
        ends = [np.array([i], "<u4").tobytes() for i in (self.bos, self.eos)]
        cut = [self.split.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if 2 * self.held > CACHE:
            self.past, self.known, self.held = self.known, {}, 0
        own = [[*map(self.known.get, x)] for x in cut]
        fresh = {s for x, y in zip(cut, own, strict=True) if None in y for s, i in zip(x, y, strict=True) if i is None}
        if fresh:
            if new := self.recalled(fresh):
                self.learn(new)
            own = [y if None not in y else [self.known[s] if i is None else i for s, i in zip(x, y, strict=True)] for x, y in zip(cut, own, strict=True)]
        out = [b"".join([ends[0], *x, ends[1]]) for x in own]
        probe = next((i for i, t in enumerate(texts) if t), None)
        if probe is not None and np.frombuffer(out[probe], "<u4").tolist() != self.sp.encode(texts[probe], add_bos=True, add_eos=True):
            raise AssertionError("the agenda and the library differ on a whole text")
        return out


_encoders: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """One encoder for each model and Python worker."""
    if model_file not in _encoders:
        _encoders[model_file] = Encoder(model_file)
    return _encoders[model_file]


NEW = ["ids array<int>", "n_tokens long", "ids_sha256 string", "decoded string", "decoded_sha256 string"]
PART = 1 << 20


def pieces(docs: DataFrame, model_file: str, digests_only: bool = False) -> DataFrame:
    """docs with ids, n_tokens, the digest of the ids, the decoded text and its digest.

    digests_only leaves out the ids and the decoded text.
    """
    new = [x for x in NEW if not (digests_only and x.split()[0] in ("ids", "decoded"))]
    made = [x.split()[0] for x in new]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in made))
    at = [c.lower() for c in docs.columns].index("text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from blockloom.llm.text import slices

        enc = encoder(model_file)
        for batch in batches:
            for a, b, _, _ in slices(batch.column(at), PART):
                part = batch.slice(a, b - a)
                own = enc.encode(part.column(at).to_pylist())
                columns = {"n_tokens": pa.array([len(x) // 4 for x in own], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string())}
                texts = enc.sp.decode([np.frombuffer(x, "<u4").tolist() for x in own], num_threads=1)
                columns["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
                if not digests_only:
                    columns["decoded"] = pa.array(texts, pa.string())
                    off = np.cumsum([0, *(len(x) // 4 for x in own)]).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(own), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, *(columns[n] for n in made)], names=[*part.schema.names, *made])

    return mapped(docs, encoded, extended(docs, ", ".join(new)))
