"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; one linear classifier over hashed byte n-grams predicts each bit. Decoding
sums, over the bits, a logistic loss of the margin against the codeword's bit, weighted by how well the bit did in
training; the nearest codeword wins, its share of the exponentiated losses is the score, and a small lead over the
second is flagged as ambiguous. Up to five languages have the exhaustive code, more have random codewords drawn apart.

The classifiers are fitted on a bounded sample: TRAIN_ROWS labelled rows at most, spread evenly over the languages and
chosen by a hash of the row, each as its whole text and as one short run of its words. Every text is predicted whole.

Defined results: a null text or one without a letter gives und with score 0, as does every text when there is no
labelled row; rows with a null lang are never learned from; ties go to the language that sorts first; repeated rows are
predicted row by row; extra columns are carried along unless they clash with a result column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm import text as T
from blockloom.llm.shared import carried, extended, mapped

ORDERS = (1, 2, 3)
BITS = 10
DIM = len(ORDERS) << BITS
TRAIN_ROWS = 1500
RIDGE = 1e-3
AMBIGUOUS = 0.2
DOCS = 512
UNKNOWN = "und"
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
LOWER[[9, 10, 11, 12, 13]] = 32


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Unit vectors of square roots of hashed n-gram shares, a row for each document of a slice."""
    n_docs, size = len(off) - 1, 1 << BITS
    code = LOWER[raw]
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(raw))  # bytes from here to the document's end
    out = np.zeros((n_docs, DIM), np.float32)
    for i, n in enumerate(ORDERS):
        if len(raw) < n:
            continue
        gram = np.zeros(len(raw) - n + 1, np.uint64)
        for k in range(n):
            gram = gram * T.BASE + code[k : k + len(gram)]
        at = ((gram * T.MULT) >> np.uint64(64 - BITS)).astype(np.int64)
        inside = left[: len(gram)] >= n
        counts = np.bincount((doc[: len(gram)] * size + at)[inside], minlength=n_docs * size)
        part = np.sqrt(counts.reshape(n_docs, size), dtype=np.float32)
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        out[:, i * size : (i + 1) * size] = part / np.maximum(norm, 1e-9)
    return out / np.sqrt(len(ORDERS), dtype=np.float32)


def parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of bounded size and number of documents."""
    for first in range(0, len(texts), DOCS):
        for a, b, raw, off in T.slices(texts.slice(first, DOCS)):
            yield first + a, first + b, raw, off


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """One row of +1 and -1 for each of n classes, no two alike nor opposite."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:  # exhaustive: every split into two sides
        bits = [[1 if c == 0 else (-1 if s >> (c - 1) & 1 else 1) for c in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(bits, np.int8).T
    rng = np.random.default_rng(seed)
    length = 15 * max(4, int(np.ceil(np.log2(n))))
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        code = code[:, np.abs(code.sum(0)) < n]
        dot = np.abs(code.astype(np.int32) @ code.T.astype(np.int32)) - np.eye(n, dtype=np.int32) * 10**6
        if code.shape[1] - dot.max() > apart:
            best, apart = code, code.shape[1] - dot.max()
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray
    sharp: float

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, and lead over the second."""
        margin = (x @ self.weights + self.bias)[:, None, :] * self.code[None]
        loss = (np.logaddexp(0, -self.sharp * margin.astype(np.float64)) * self.bit_weight).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = 0
        return best, top, top - (p.max(1) if len(self.langs) > 1 else 0)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str]) -> Model:
    """Ridge-regressed bits, every language having the same weight."""
    code = codewords(len(langs))
    target = code[y].astype(np.float32)
    weight = (1 / np.maximum(np.bincount(y, minlength=len(langs)), 1))[y].astype(np.float32)
    weight *= len(y) / weight.sum()
    mean, mid = np.average(x, 0, weight).astype(np.float32), np.average(target, 0, weight).astype(np.float32)
    xc = (x - mean) * np.sqrt(weight)[:, None]
    gram = xc.T @ xc
    gram[np.diag_indices(len(gram))] += np.float32(RIDGE * len(y))
    w = np.linalg.solve(gram, xc.T @ ((target - mid) * np.sqrt(weight)[:, None])).astype(np.float32)
    b = (mid - mean @ w).astype(np.float32)
    right = (np.sign(x @ w + b) == target).mean(0)
    return Model(langs, code, w, b, np.maximum(right - 0.5, 0.01) * 2, 4.0)


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """At most rows different labelled rows, about as many of each language, chosen by a hash of the row.

    Copies count once. Of more than rows languages, those with the most different rows are taken, ties by name.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.shiftrightunsigned(F.xxhash64("text", "lang"), 1).alias("_h"))
    counts = docs.select("lang", "_h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in counts.orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return docs.drop("_h").limit(0)
    each = max(1, rows // len(counts))
    limits = docs.sparkSession.createDataFrame([(k, min(1.0, 0.9 * each / n) * 2.0**63) for k, n in counts.items()], "_l string, _most double")
    chosen = docs.join(F.broadcast(limits), F.col("lang") == F.col("_l")).where(F.col("_h") <= F.col("_most"))  # rows languages at most
    chosen = chosen.groupBy("lang", "_h").agg(F.first("text").alias("text"))
    chosen = chosen.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_r") <= each)
    return chosen.select("lang", "text", "_h").orderBy("_h").limit(rows).drop("_h")  # no more than rows are left before the limit


def learn(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model from a bounded sample of labelled (lang, text); None without a labelled row."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            short = []
            for i, x in enumerate(texts):
                words = x.as_py().split()
                n = (1, 2, 4, 8)[i % 4]
                at = (i * 7919) % max(1, len(words) - n + 1)
                short.append(" ".join(words[at : at + n]))
            for column in (texts, pa.array(short, pa.string())):
                for a, b, raw, off in parts(column):
                    x = features(raw, off)
                    out = []
                    for v in x:
                        on = np.flatnonzero(v)
                        out.append(on.astype("<u2").tobytes() + v[on].astype("<f4").tobytes())
                    yield pa.RecordBatch.from_arrays([langs.slice(a, b - a), pa.array(out, pa.binary())], names=["lang", "v"])

    found = sample(labelled, rows).mapInArrow(vectors, "lang string, v binary").collect()  # 2 * rows sparse vectors at most
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    langs = sorted({r["lang"] for r in found})
    x = np.zeros((len(found), DIM), np.float32)
    for i, r in enumerate(found):
        n = len(r["v"]) // 6
        x[i, np.frombuffer(r["v"], "<u2", n)] = np.frombuffer(r["v"], "<f4", n, 2 * n)
    at = {v: i for i, v in enumerate(langs)}
    return fit(x, np.array([at[r["lang"]] for r in found]), langs)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    made = ("lang_pred", "score", "ambiguous")
    docs, columns = carried(docs, ("text",), made)
    if model is None:
        return docs.select(*columns(docs), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    at = docs.columns.index("text")
    schema = extended(docs, "lang_pred string, score double, ambiguous boolean")
    docs = docs.withColumn("_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.langs, object)
        for batch in batches:
            letter = np.asarray(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), bool)
            for a, b, raw, off in parts(batch.column(at)):
                best, score, lead = model.predict(features(raw, off))
                on = letter[a:b]
                rest = batch.slice(a, b - a).columns[:-1]
                values = [pa.array(np.where(on, names[best], UNKNOWN), pa.string()), pa.array(np.where(on, score, 0.0)), pa.array(~on | (lead < AMBIGUOUS))]
                yield pa.RecordBatch.from_arrays([*rest, *values], names=[*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    out = mapped(docs, run, schema)
    return out.select(*columns(out), *made)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text modulo 5 is 0; a null id counts as held out, so it is never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
