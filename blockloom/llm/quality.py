"""Quality rules from repetition coverage.

Word n-grams of several lengths are found by hashes rolled over the words of a whole Arrow batch in numpy. A document's
coverage for a length is the share of its word characters inside n-grams that occur twice or more in it; line coverage
is the share inside lines equal to an earlier line of it.

Defined results: a null text counts as empty and has no words; a text without words fails the base rule; repeated rows
and repeated doc_ids are judged row by row; equal texts get equal verdicts; extra columns are carried along unless
they clash with a result column, which replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import text as T
from blockloom.llm.shared import extended, mapped

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
#: Word n-gram length and the largest share of word characters that repeated n-grams of it may cover.
COVERAGE = ((5, 0.30), (7, 0.25), (10, 0.20))
MAX_LINE_SHARE = 0.30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("dup_line_chars", pa.int64()), *((f"dup_{n}gram_chars", pa.int64()) for n, _ in COVERAGE)]


def per_document(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def repeats(words: np.ndarray, doc: np.ndarray, salt: np.ndarray, n: int) -> np.ndarray:
    """Marks the words inside n-word windows that occur twice or more in their document."""
    grams = T.window_hashes(words, n)
    inside = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    again = inside[T.repeated(grams[inside] ^ salt[inside])]
    return T.covered(again, n, len(words))


def lines(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the lines of all documents, in order; ends leave out the newline."""
    feeds = np.flatnonzero(raw == 10)
    doc = np.searchsorted(off, feeds, "right") - 1  # the document that holds each newline
    starts, ends = np.empty((2, len(feeds) + len(off) - 1), np.int64)
    # a document has one line more than newlines; its first line starts with it and its last one ends with it
    at = np.arange(len(feeds)) + doc
    ends[at], starts[at + 1] = feeds, feeds + 1
    before = np.searchsorted(feeds, off) + np.arange(len(off))
    starts[before[:-1]], ends[before[1:] - 1] = off[:-1], off[1:]
    return starts, ends


def measure(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The columns of FIELDS for the documents of a slice."""
    starts, ends, first = T.bounds(raw, off)
    words = T.word_hashes(raw, starts, ends)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    salt = T.mix((doc + 1).astype(np.uint64) * T.MULT)
    lead = np.zeros(len(raw) + 1, np.int64)  # code points before each byte
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    chars = lead[ends] - lead[starts]
    upto = np.zeros(len(words) + 1, np.int64)
    np.cumsum(chars, out=upto[1:])
    out = [np.diff(first), upto[first[1:]] - upto[first[:-1]], per_document(SYMBOLS[raw], off)]

    from_, to = lines(raw, off)
    w0, w1 = np.searchsorted(starts, from_), np.searchsorted(starts, to)
    some = np.flatnonzero(w1 > w0)
    line_doc = doc[w0[some]]
    key = T.word_hashes(raw, from_[some], to[some]) ^ T.mix((line_doc + 1).astype(np.uint64) * T.MULT)
    order = np.argsort(key)  # which of equal lines counts as the first makes no difference to the sums
    dup = np.zeros(len(some), bool)
    dup[order[1:][key[order][1:] == key[order][:-1]]] = True
    n_docs = len(off) - 1
    out.append(np.bincount(line_doc[dup], minlength=n_docs).astype(np.int64))
    out.append(per_document(repeats(words, doc, salt, WINDOW), first))
    line_chars = upto[w1[some]] - upto[w0[some]]
    out.append(np.bincount(line_doc[dup], weights=line_chars[dup], minlength=n_docs).astype(np.int64))
    for n, _ in COVERAGE:
        out.append(per_document(np.where(repeats(words, doc, salt, n), chars, 0), first))
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, rest = batch.column(batch.schema.get_field_index("text")), batch
        for a, b, raw, off in T.slices(texts):
            values = measure(raw, off)
            part = rest.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, pa.int64()) for v in values)], names=[*part.schema.names, *(n for n, _ in FIELDS)])


def quality(docs: DataFrame) -> DataFrame:
    """docs with the measures of FIELDS, base_failed, failed (names of the method's rules that failed) and kept."""
    made = [*(n for n, _ in FIELDS), "base_failed", "failed", "kept"]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in made))
    out = mapped(docs, _measured, extended(docs, ", ".join(f"{n} long" for n, _ in FIELDS)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rules = [(f"dup_{n}gram", F.col(f"dup_{n}gram_chars") > most * F.col("word_chars")) for n, most in COVERAGE]
    rules.append(("dup_line", F.col("dup_line_chars") > MAX_LINE_SHARE * F.col("word_chars")))
    failed = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules)))
    return out.withColumns({"base_failed": base, "failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
