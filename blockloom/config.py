"""Settings of a reduction run: size literals, what a level switches on, and checks of options."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

CODECS = ("none", "lzfx", "lz4", "zlib", "bzip2", "lzma", "lzmaMt", "ppmd", "libbsc", "adapt", "adapt2")
DIGESTS = ("CRC64", "SHA256", "SHA512", "KECCAK256", "KECCAK512", "BLAKE256", "BLAKE512")
MIN_CHUNK, DEFAULT_CHUNK = 2048, 8 << 20
DEDUPE_CHUNK, GLOBAL_CHUNK = 1 << 20, 2 << 20
# The bytes that an arithmetic series must exceed to be worth its header, by codec.
SERIES_SPAN = {"none": 50, "lzfx": 50, "lz4": 100, "zlib": 100, "ppmd": 100, "lzma": 150, "lzmaMt": 150, "libbsc": 150, "bzip2": 200, "adapt": 200, "adapt2": 200}
LEAST_SPAN = 50


def parse_size(text: str) -> int:
    """A size such as 64, 8m or 0x10K; ValueError for another suffix or a size over 63 bits."""
    body, shift = text.strip(), 0
    if body[-1:] in set("kKmMgG"):
        shift = {"k": 10, "m": 20, "g": 30}[body[-1].lower()]
        body = body[:-1]
    value = int(body, 0) << shift
    if abs(value) >= 1 << 63:
        raise ValueError(f"{text} does not fit 63 bits")
    return value


@dataclass(frozen=True)
class Config:
    """Options are checked on construction; from_level() chooses as the levels do, resolve() fits them to an input."""

    codec: str = "lzma"
    level: int = 6
    chunk_size: int = 0
    dedupe: str = "none"
    block_bits: int = 2
    similar: str = "none"
    delta: bool = False
    lzp: bool = False
    exe: bool = False
    media: bool = False
    strides: tuple[int, ...] = (2, 4, 8)
    digest: str = "SHA256"
    archive: bool = False
    sort: bool = False
    pipe: bool = False
    cipher: str | None = None
    key_bytes: int = 32

    def __post_init__(self):
        for bad, what in (
            (self.codec not in CODECS, f"unknown codec {self.codec}"), (not 0 <= self.level <= 14, "level is 0 to 14"),
            (self.dedupe not in ("none", "chunk", "fixed", "global", "global_fixed"), f"unknown deduplication {self.dedupe}"),
            (not 0 <= self.block_bits <= 5, "block size is 0 to 5"), (self.similar not in ("none", "normal", "extra"), f"unknown similarity {self.similar}"),
            (self.similar != "none" and self.dedupe not in ("chunk",), "similar blocks need deduplication inside chunks"),
            (self.digest not in DIGESTS, f"unknown digest {self.digest}"), (self.digest == "CRC64" and self.dedupe != "none", "CRC64 is too weak for deduplication"),
            (self.chunk_size and self.chunk_size < MIN_CHUNK, f"chunks have {MIN_CHUNK} bytes at least"), (self.pipe and self.archive, "an archive cannot be piped"),
            (self.key_bytes not in (16, 32), "keys have 16 or 32 bytes"), (self.cipher not in (None, "AES"), "AES only"),
        ):
            if bad:
                raise ValueError(what)

    @property
    def block_size(self) -> int:
        return 1 << (11 + self.block_bits)

    @property
    def series_span(self) -> int:
        return max(LEAST_SPAN, SERIES_SPAN[self.codec])

    @classmethod
    def from_level(cls, codec: str = "lzma", level: int | None = None, archive: bool = False, pipe: bool = False, chunk_size: int = 0) -> Config:
        level = (1 if codec == "lz4" else 6) if level is None else level
        chunk = chunk_size or DEFAULT_CHUNK + max(0, level - 8) * (DEFAULT_CHUNK // 4)
        dedupe = "none"
        if level > 3:
            dedupe = "global" if chunk >= GLOBAL_CHUNK else "chunk" if chunk >= DEDUPE_CHUNK else "none"
        return cls(
            codec=codec, level=level, chunk_size=chunk, dedupe=dedupe, delta=level > 4, lzp=level > 9, exe=archive and level > 8, media=archive and level > 10,
            strides=(2, 4, 8, 3, 5, 6, 7) if level > 9 else (2, 4, 8), archive=archive, pipe=pipe, sort=archive and (level > 4 or codec == "lz4" and level > 1),
        )

    @classmethod
    def from_args(cls, text: str) -> Config:
        """Options in one string: -c codec -l level -s size -B bits, and the switches G F D E EE L P p n."""
        found: dict = {}
        words = iter(text.split())
        for w in words:
            key = w.lstrip("-")
            if key in ("c", "l", "s", "B", "S"):
                value = next(words)
                found |= {"c": {"codec": value}, "l": {"level": int(value) if key == "l" else 0}, "s": {"chunk_size": parse_size(value) if key == "s" else 0}, "B": {"block_bits": int(value) if key == "B" else 0}, "S": {"digest": value}}[key]
            elif key in ("G", "F", "D", "E", "EE", "L", "P", "p", "n"):
                found |= {"G": {"dedupe": "global"}, "F": {"dedupe": "fixed"}, "D": {"dedupe": "chunk"}, "E": {"similar": "normal", "dedupe": "chunk"}, "EE": {"similar": "extra", "dedupe": "chunk"}, "L": {"lzp": True}, "P": {"delta": True}, "p": {"pipe": True}, "n": {"sort": False}}[key]
            else:
                raise ValueError(f"unknown option {w}")
        return cls(**found)

    @classmethod
    def from_file(cls, path: str) -> Config:
        """Settings from lines of the form name=value; empty lines and those that begin with # do not count."""
        kinds, found = {f.name: f.type for f in fields(cls)}, {}
        for number, line in enumerate(Path(path).read_text().splitlines(), 1):
            name, equals, value = (x.strip() for x in line.partition("="))
            if not name or name.startswith("#"):
                continue
            if not equals or name not in kinds:
                raise ValueError(f"{path}, line {number}: {line}")
            kind = kinds[name]
            if kind == "bool" and value not in ("true", "false"):
                raise ValueError(f"{path}, line {number}: true or false")
            found[name] = {"bool": lambda v: v == "true", "int": parse_size, "str": str}[kind](value) if kind in ("bool", "int", "str") else tuple(map(int, value.split(","))) if name == "strides" else value or None
        return cls(**found)

    def to_file(self, path: str) -> None:
        text = {k: str(v).lower() if isinstance(v, bool) else ",".join(map(str, v)) if isinstance(v, tuple) else "" if v is None else str(v) for k, v in asdict(self).items()}
        Path(path).write_text("".join(f"{k}={v}\n" for k, v in text.items()))

    def resolve(self, size: int) -> Config:
        """Global deduplication of an input of one chunk is deduplication inside it; a tiny input has none."""
        if self.dedupe == "none":
            return self
        if size < self.block_size:
            return replace(self, dedupe="none", similar="none")
        if self.dedupe == "global" and self.chunk_size and size <= self.chunk_size:
            return replace(self, dedupe="chunk")
        return self


def index_bytes(size: int, block_bits: int, digest_bytes: int = 32) -> dict[str, int]:
    """Bytes that an in-memory index of all blocks, or of segment sketches, of so much data would take."""
    blocks = -(-size // (1 << (11 + block_bits)))
    segments = -(-size // ((8 << 20) * max(1, block_bits)))
    return {"simple": blocks * (16 + digest_bytes), "segmented": segments * 20 * 16}


def segment_blocks(block_bits: int) -> int:
    """Blocks in a segment."""
    size = (4 << 20) if block_bits == 0 else (8 << 20) * block_bits
    return size // (1 << (11 + block_bits))


def aligned_chunk(chunk_size: int, block_bits: int) -> int:
    """The chunk size rounded up to whole segments."""
    size = segment_blocks(block_bits) << (11 + block_bits)
    return -(-chunk_size // size) * size
