"""Word frequencies, the choice of a dictionary, and encoding with it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.shared import kept, mapped

WORD_MIN, WORD_MAX = 3, 50
LEAST_BYTES = 4500
BASE = 217
NUMBER = re.compile(rb"(?<![0-9])[1-9][0-9]{4,8}(?![0-9])")
SEPARATORS = r"[\x00-\x20.,;:!?()\[\]{}<>\"']+"
#: Of sequence data (FASTA), lines are the words.
LINES = r"\n+"


def word_frequency(docs: DataFrame, text: str = "text", separators: str = SEPARATORS, most: int = WORD_MAX) -> DataFrame:
    """word, n for words of WORD_MIN to `most` bytes, their first letter in lower case, but for lines."""
    words = docs.select(F.explode(F.split(text, separators)).alias("word"))
    if separators != LINES:
        words = words.select(F.concat(F.lower(F.substring("word", 1, 1)), F.expr("substring(word, 2)")).alias("word"))
    words = words.where(F.octet_length("word").between(WORD_MIN, most))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def candidates(frequency: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Words worth looking at: occurrences times length above a bound, and more than one occurrence."""
    out = frequency.withColumn("len", F.octet_length("word").cast("long"))
    return out.where((F.col("n") * F.col("len") > least) & (F.col("n") > 1)).withColumn("weight", (F.col("n") - 1) * (F.col("len") - 1))


def ranked(chosen: DataFrame) -> DataFrame:
    """Candidates in dictionary order with rank, code bytes and what each saves: word, rank, saving, total_saving.

    Ranks and running sums are two-level: ranges of the order are the parts, and only rows of one part meet in a window.
    The parts are checkpointed, since another run of the range partitioning could draw other bounds.
    """
    by = [F.desc("weight"), F.desc("len"), F.desc("word")]
    inside = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    def after(rows: DataFrame, value: Column) -> DataFrame:
        """rows with column _before: the sum of value over all earlier parts."""
        sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"))
        sums = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
        return rows.join(F.broadcast(sums), "_part")  # a row for each part

    rows = kept(chosen.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    out = after(rows, F.lit(1)).withColumn("rank", F.row_number().over(inside) - 1 + F.col("_before")).drop("_before")
    code = F.when(F.col("rank") == 0, 1).when(F.col("rank") < BASE, 2).when(F.col("rank") < BASE**2, 3).when(F.col("rank") < BASE**3, 4).otherwise(5)
    out = out.withColumn("saving", F.col("n") * F.col("len") - F.col("len") - F.col("n") * code).where("saving > 0")
    out = after(out, F.col("saving")).withColumn("total_saving", F.sum("saving").over(inside) + F.col("_before"))
    return out.drop("_part", "_before")


ESCAPE, WORD, UPPER, DIGITS = b"\x01", b"\x02", b"\x03", b"\x04"


def number(i: int) -> bytes:
    """i in base 217 with digits above the control bytes, then an end mark."""
    out = bytearray()
    while True:
        out.append(32 + i % BASE)
        i //= BASE
        if not i:
            return bytes(out) + b"\x05"


def unnumber(data: bytes, at: int) -> tuple[int, int]:
    end = data.index(b"\x05", at)
    return sum((c - 32) * BASE**k for k, c in enumerate(data[at:end])), end + 1


def encode(text: bytes, index: dict[bytes, int], lines: bool = False) -> bytes:
    """Words of the dictionary as numbers, with a mark for a capital first letter; numbers of 5 to 9 digits re-based.

    With lines the words are whole lines, as they stand, and numbers stay.
    """
    out, last = [], 0

    def plain(part: bytes) -> bytes:
        return re.sub(rb"[\x01-\x05]", lambda m: ESCAPE + m[0], part)

    for m in re.finditer(rb"[^\n]+" if lines else rb"[A-Za-z\x80-\xff]{%d,%d}|" % (WORD_MIN, WORD_MAX) + NUMBER.pattern, text):
        w = m[0]
        if w in index:
            code = WORD + number(index[w])
        elif lines:
            continue
        elif w[:1].isdigit():
            code = DIGITS + number(int(w))
        elif w[:1].isupper() and w[:1].lower() + w[1:] in index:
            code = UPPER + number(index[w[:1].lower() + w[1:]])
        else:
            continue
        out += [plain(text[last : m.start()]), code]
        last = m.end()
    return b"".join([*out, plain(text[last:])])


def decode(data: bytes, words: list[bytes]) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        c = data[at : at + 1]
        if c == ESCAPE:
            out += data[at + 1 : at + 2]
            at += 2
        elif c in (WORD, UPPER, DIGITS):
            i, end = unnumber(data, at + 1)
            out += str(i).encode() if c == DIGITS else words[i] if c == WORD else words[i][:1].upper() + words[i][1:]
            at = end
        else:
            out += c
            at += 1
    return bytes(out)


def encoded(streams: DataFrame, words: list[str], lines: bool = False) -> DataFrame:
    """stream_id, raw_bytes, encoded_bytes (raw if coding is no gain) and whether decoding gives the stream back."""
    kind = streams.schema["stream_id"].dataType.simpleString()
    raw = [w.encode() for w in words]
    index = {w: i for i, w in enumerate(raw)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [d.as_py() for d in batch.column(1)]
            code = [encode(d, index, lines) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([min(len(c), len(d)) for c, d in zip(code, data, strict=True)], pa.int64()), pa.array([decode(c, raw) == d for c, d in zip(code, data, strict=True)])], names=["stream_id", "raw_bytes", "encoded_bytes", "restored"])

    return streams.select("stream_id", "data").transform(mapped, run, f"stream_id {kind}, raw_bytes long, encoded_bytes long, restored boolean")
