"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into source parts by a hash of their content, so a part holds the same rows whenever a task is run again.
The driver draws, part by part, how many of its rows go to each shard: a multivariate hypergeometric matrix whose rows
sum to the parts' counts and whose columns sum to the shards' exact sizes. Inside a part a random order (the local
permutation) hands the first so many rows to the first shard, and so on; the rows are exchanged; inside a shard another
random order gives the slots. Together this is a uniform permutation cut into shards.

Law: rows. Shard sizes differ by one row at most, whatever the texts' lengths; groups of equal texts are not kept
together, since a group can be larger than a shard.

Defined results: a null text counts as empty (16 bytes, crc 0); repeated rows are separate rows; rows that are equal in
all columns used for ordering take their places among each other in any order; extra columns are carried along unless
they clash with a result column, which replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.running import random_key, running
from blockloom.llm.shared import carried

#: Rows of a source part on average, as long as there are no more than MOST_PARTS of them; at least as many as shards.
PART_ROWS = 4096
MOST_PARTS = 20_000
SEED = 20240501
MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def communication_matrix(parts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows: source parts; columns: shards; entry: rows that move. Its margins are exact."""
    total = sum(parts)
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(parts), shards), np.int64)
    for i, n in enumerate(parts):
        out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        left -= out[i]
    return out


def shards(docs: DataFrame, n_shards: int = 40, seed: int = SEED, part_rows: int = PART_ROWS, drop_text: bool = False) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    spark = docs.sparkSession
    held, columns = carried(docs, ("doc_id", "text"), MADE)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = held.withColumns({"size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text.cast("binary")).cast("long")})
    docs = docs.drop("text") if drop_text else docs
    n = docs.count()
    parts = min(MOST_PARTS, max(n_shards, -(-n // part_rows)))
    id_ = ["doc_id", "text_crc32", "size"]
    rows = docs.withColumns({"_part": F.pmod(F.xxhash64(F.lit(seed + 1), *id_), F.lit(parts)).cast("long"), "_local": random_key(seed + 2, *id_), "_final": random_key(seed + 3, *id_)})
    counts = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # MOST_PARTS rows at most
    matrix = communication_matrix([counts.get(i, 0) for i in range(parts)], n_shards, seed)
    ends = spark.createDataFrame([(i, e) for i, e in enumerate(np.cumsum(matrix, 1).tolist())], "_p long, _ends array<long>")
    # parts are bounded by part_rows unless MOST_PARTS is reached; running() then cuts them on
    rows = running(rows, "_part", "_local", id_, F.lit(1), "_place", n, part_rows * parts)
    placed = rows.join(F.broadcast(ends), F.col("_part") == F.col("_p"))  # at most MOST_PARTS rows of n_shards numbers
    shard = F.aggregate("_ends", F.lit(0), lambda a, e: a + F.when(F.col("_place") >= e, 1).otherwise(0))
    placed = placed.withColumn("shard", shard.cast("int")).drop("_part", "_p", "_ends", "_place", "_local")
    out = running(placed, "shard", "_final", id_, F.lit(1), "slot", n)
    return out.select(*columns(out), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
