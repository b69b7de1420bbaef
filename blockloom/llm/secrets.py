"""Secret scans: base patterns, and dictionary-primed zstandard novelty.

Base spans come from three patterns. Beyond them, every token of NOVEL_LENGTH or more characters that stands within
CONTEXT characters after a sensitive word is a candidate. '=' parts tokens unless it pads the end of one, so in
access_key=V it is V; a token joined to the word itself is none. A run of tokens parted by '=' alone, none of them
reported, is a candidate as a whole.

A candidate is compressed with a raw-content dictionary and reported when its marginal compressed size is above NOVELTY
of its length. The dictionary holds common identifiers, the words that stand near sensitive words in the most different
surroundings of all documents (see identifiers()), and the text around the candidate; so identifiers, words of the
corpus and words seen nearby cost a few bytes, random strings cost nearly all of theirs. From 64 bytes on zstandard's
entropy coder shortens random strings of small alphabets too, so a candidate longer than PIECE is also reported when any
PIECE of it is novel; pieces begin every STEP characters, and one ends the candidate. A candidate that base spans leave
fewer than NOVEL_LENGTH characters of is not reported again. Base spans stay whatever their novelty, which is measured
and returned for each.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned row by row; spans are code-point
offsets with exclusive ends; equal starts are ordered by kind as in KINDS; extra columns are carried along unless they
clash with a result column, which replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.shared import extended, mapped

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW](?:[oO][rR][dD]|[dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
ASSIGNED = ("passw", "secret", "token", "api")
WORDS = ("passw", "passphrase", "secret", "token", "api", "credential", "auth", "bearer", "key", "signature")
SENSITIVE = re.compile(r"(?i:pass(?:word|wd|phrase)|secret|token|api.?key|credential|auth|bearer|private.?key|access.?key|signature)")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
PART = re.compile(r"[A-Za-z0-9+/_-]+(?:=+\Z)?")
ASSIGN_LENGTH, NOVEL_LENGTH, CONTEXT, NEAR, NOVELTY = 12, 16, 48, 256, 0.9
#: Words of the corpus that may enter the dictionary: runs of letters, upper case only at the front. Of those that stand
#: in SURROUNDINGS different places or more, the DICTIONARY most frequent make the dictionary, which zstandard needs small.
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][a-z]{3,15}(?![a-z0-9])|(?<=[_/-])[A-Za-z][a-z]{3,15}(?![a-z0-9])")
SURROUNDINGS, DICTIONARY = 3, 2048
PIECE, STEP = 48, 24
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key client_secret client_id "
    "authorization authenticate bearer credential signature session_id user_id username account default "
    "configuration environment production development staging localhost example changeme placeholder "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 your_api_key_here your-secret-token "
    "https http www .com .org .net public static final string return function const import export class"
).encode()


def base_spans(text: str, lower: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; each pattern's own matches do not overlap."""
    out = []
    if ("=" in text or ":" in text) and any(w in lower for w in ASSIGNED):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def identifiers(docs: DataFrame) -> bytes:
    """The corpus' part of the dictionary, from all documents: the words near sensitive words, the most frequent last.

    A word counts once for each different surroundings of NEAR characters, so that copies of a document, and a secret in
    them, count once.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, int]] = set()
            for x in batch.column(0):
                text = x.as_py()
                if text is None or not any(w in (lower := text.lower()) for w in WORDS):
                    continue
                last = 0
                for m in SENSITIVE.finditer(text):
                    if m.start() < last:
                        continue
                    part = text[max(0, m.start() - NEAR) : (last := m.end() + CONTEXT + NEAR)]
                    place = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little", signed=True)
                    found |= {(w, place) for w in WORD.findall(part)}
            words, places = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.int64())], names=["word", "place"])

    rows = mapped(docs.select("text"), near, "word string, place long").distinct()
    counts = rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= SURROUNDINGS)
    top = counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()  # DICTIONARY words at most
    return " ".join(r["word"] for r in reversed(top)).encode()


def compressor(near: bytes, words: bytes = b"") -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + words + b"\n" + near, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: bytes, near: bytes, words: bytes = b"") -> Iterator[float]:
    """Marginal compressed bytes of the candidate, and of its pieces, after its surroundings and the identifiers, over the length."""
    c = compressor(near, words)
    least = len(c.compress(b""))
    yield (len(c.compress(candidate)) - least) / len(candidate)
    if len(candidate) > PIECE:
        for i in (*range(0, len(candidate) - PIECE, STEP), len(candidate) - PIECE):
            yield (len(c.compress(candidate[i : i + PIECE])) - least) / PIECE


def surroundings(text: str, a: int, b: int) -> bytes:
    return (text[max(0, a - NEAR) : a] + text[b : b + NEAR]).encode()


def measured(text: str, span: tuple[int, int, int], words: bytes = b"") -> float:
    """The novelty of a span: of its value alone where a name stands before it."""
    a, kind, b = span
    if kind == 0:
        a = ASSIGN.match(text, a).start(1)
    return max(novelty(text[a:b].encode(), surroundings(text, a, b), words))


def is_novel(text: str, a: int, b: int, base: list[tuple[int, int, int]], words: bytes) -> bool:
    bare, at = 0, a  # characters outside base spans
    for s, _, e in base:
        bare += max(0, min(s, b) - at)
        at = max(at, min(e, b))
    if bare + b - at < NOVEL_LENGTH:
        return False
    return any(x > NOVELTY for x in novelty(text[a:b].encode(), surroundings(text, a, b), words))


def novel_spans(text: str, base: list[tuple[int, int, int]], words: bytes = b"") -> list[tuple[int, int, int]]:
    out, last = [], 0
    for word in SENSITIVE.finditer(text):
        for m in TOKEN.finditer(text, max(last, word.end()), min(len(text), word.end() + CONTEXT)):
            a, b = m.span()
            if b == word.end() + CONTEXT:  # the token may go on beyond the context
                b = TOKEN.match(text, a).end()
            last = max(last, b)
            glued = bool(a and TOKEN.match(text[a - 1]))
            parts = [(a + p.start(), a + p.end()) for p in PART.finditer(text[a:b])]
            if glued:
                parts = [p for p in parts if p[0] > a]  # the first one belongs to the word
            found = [(i, 3, j) for i, j in parts if is_novel(text, i, j, base, words)]
            if not found and not glued and is_novel(text, a, b, base, words):
                found = [(a, 3, b)]
            out += found
    return out


def scan(text: str | None, words: bytes = b"") -> list[tuple[int, int, int]]:
    """(start, kind index, end) of all spans, by start and then kind."""
    if not text:
        return []
    lower = text.lower()  # only for a quick look: lower-casing can move offsets
    base = base_spans(text, lower)
    return sorted(base + novel_spans(text, base, words)) if any(w in lower for w in WORDS) else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[REDACTED]") -> str | None:
    """The text with each union of overlapping spans replaced by the mark."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            at = end
        out += [text[at:a], mark]
        end = b
    return "".join([*out, text[end:]])


NEW = ["n_assign long", "n_access long", "n_hex long", "n_novel long", "base_sha256 string", "spans string", "novelty string"]


def secrets(docs: DataFrame, redact: bool = False) -> DataFrame:
    """docs with counts by kind, the digest of the base spans, all spans and their novelty in percent; with redact, text
    without the secrets. The words of the dictionary are counted over all of docs first."""
    made = [x.split()[0] for x in NEW]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in made))
    at = [c.lower() for c in docs.columns].index("text")

    words = identifiers(docs)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts, news = [], [], []
            for x in batch.column(at):
                x = x.as_py()
                spans = scan(x, words)
                found.append(spans)
                news.append(",".join(str(round(100 * measured(x, span, words))) for span in spans))
                texts.append(redacted(x, spans) if redact else None)
            columns = list(batch.columns)
            if redact:
                columns[at] = pa.array(texts, batch.schema.field(at).type)
            counts = [pa.array([sum(s[1] == k for s in x) for x in found], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(joined([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *counts, digest, pa.array([joined(x) for x in found], pa.string()), pa.array(news, pa.string())], names=[*batch.schema.names, *made])

    return mapped(docs, scanned, extended(docs, ", ".join(NEW)))
