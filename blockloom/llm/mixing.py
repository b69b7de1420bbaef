"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled and laid end to end as a stream of words, cut into blocks of equal size. Slot i of
the schedule maps the i-th point of the golden-ratio sequence through the cumulative shares to a source; ranking the
slots of each source says which of its blocks a slot takes, starting over after the last. A source stops when its target
is reached, so its last slot can take part of a block; the few slots that the sequence left short follow at the end.

Targets: weights are dealt to the sources by code point, null last, and share all words; a target stops at most_times
the source's size, and the excess is shared again by weight among the others until none is above.

Defined results: a null text has size 0; documents without words are never taken; a null source is a source of its own;
rows equal in doc_id, source and text share what is taken of them evenly, rounded down; extra columns are carried along
unless they clash with a result column, which replaces them; an empty table gives an empty result, and a table without
any word has targets 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import text as T
from blockloom.llm.running import random_key, running
from blockloom.llm.shared import carried, checkpoint, extended, mapped

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
BLOCK = 1024
MOST_SOURCES = 100_000
GOLDEN = (math.sqrt(5) - 1) / 2
GOLDEN_64 = np.uint64(0x9E3779B97F4A7C15)  # GOLDEN in units of 2**-64
SEED = 77
MADE = ("size", "source_size", "target", "taken", "first_slot")


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """columns, the text's hash _id and its number of words _size: longest runs of bytes other than space and \\t to \\r."""
    rows = docs.select(*columns, F.xxhash64("text").alias("_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in T.slices(batch.column(batch.num_columns - 1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(T.bounds(raw, off)[2]), pa.int64())], names=[*part.schema.names[:-1], "_size"])

    return mapped(rows, run, extended(rows.drop("text"), "_size long"))


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> list[float]:
    """The targets of sources in their order: shares by weight, filled up to each source's bound."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, free, out = float(sum(sizes)), [i for i, n in enumerate(sizes) if n], [0.0] * len(sizes)
    while free:
        share = left / math.fsum(weight[i] for i in free)
        full = [i for i in free if share * weight[i] > most_times * sizes[i]]
        for i in full or free:
            out[i] = float(most_times * sizes[i]) if full else share * weight[i]
        left -= math.fsum(out[i] for i in full)
        free = [i for i in free if i not in set(full)] if full else []
    return out


def schedule(spark: SparkSession, need: list[int]) -> DataFrame:
    """slot, source number _s and rank, the slots of the source that came before; source s has need[s] slots."""
    n_slots = sum(need)
    edges = np.cumsum(need)[:-1] / max(1, n_slots)

    def located(batches):
        for batch in batches:
            # in integers, so that the points of large numbers are as exact as those of small ones
            turned = batch.column(0).to_numpy().astype(np.uint64) * GOLDEN_64 + np.uint64(1 << 63)
            u = (turned >> np.uint64(11)).astype(np.float64) / 2.0**53
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(edges, u, "right").astype(np.int32))], names=["slot", "_s"])

    placed = spark.range(n_slots).mapInArrow(located, "slot long, _s int")
    placed = placed.withColumn("_at", F.col("slot") * F.lit(((1 << 63) - 1) // max(1, n_slots)))
    ranked = running(placed, "_s", "_at", ["slot"], F.lit(1), "rank", n_slots)
    needs = spark.createDataFrame(list(enumerate(need)), "_i int, _need long")  # MOST_SOURCES rows at most
    used = ranked.join(F.broadcast(needs), F.col("_s") == F.col("_i")).where(F.col("rank") < F.col("_need"))
    had = placed.groupBy("_s").agg(F.count("*").alias("_had"))
    late = needs.join(had, needs["_i"] == had["_s"], "left").withColumn("_had", F.coalesce("_had", F.lit(0))).where(F.col("_had") < F.col("_need"))
    late = late.select(F.col("_i").alias("_s"), F.explode(F.sequence(F.col("_had"), F.col("_need") - 1)).alias("rank"))
    return used.select("slot", "_s", "rank").unionByName(late.select((F.col("rank") * len(need) + F.col("_s") + n_slots).alias("slot"), "_s", "rank"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: int = MOST_TIMES, block: int = BLOCK, seed: int = SEED, drop_text: bool = False) -> DataFrame:
    """docs with size, source_size, target, taken (words that the mix takes of each row, repeats counted) and first_slot,
    the place in the schedule of the first block that takes of it (null if none does)."""
    spark = docs.sparkSession
    if drop_text:
        # the texts are read once, and everything else is done with what this keeps
        held, columns = carried(docs, ("doc_id", "source", "text"), MADE)
        narrow = checkpoint(counted(held, [c for c in held.columns if c != "text"]))
        rows = narrow
    else:
        held, columns = carried(docs, ("doc_id", "source", "text"), MADE)
        narrow = checkpoint(counted(held, ["doc_id", "source"]))
        rows = held.withColumn("_id", F.xxhash64("text"))
    found = narrow.groupBy("source").agg(F.sum("_size").alias("n"), F.count("*").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in found]
    target = targets(sizes, weights, most_times)
    take = [min(round(t), most_times * n) for t, n in zip(target, sizes, strict=True)]
    need = [k // n * -(-n // block) + -(-(k % n) // block) if n else 0 for k, n in zip(take, sizes, strict=True)]
    table = [(i, r["source"], r["n"], t, k) for i, (r, t, k) in enumerate(zip(found, target, take, strict=True))]
    sources = F.broadcast(spark.createDataFrame(table, "_s int, _source string, source_size long, target double, _take long"))  # MOST_SOURCES rows at most

    items = narrow.groupBy("source", "doc_id", "_id").agg(F.count("*").alias("_n"), F.max("_size").alias("_len"))
    items = items.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    used = items.where((F.col("_len") > 0) & (F.col("_take") > 0)).select("_s", "doc_id", "_id", "_n", "_len", F.col("source_size").alias("_all"), F.col("_take").alias("_most"))
    used = used.withColumn("_key", random_key(seed, "doc_id", "_id"))
    laid = running(used, "_s", "_key", ["doc_id", "_id"], F.col("_n") * F.col("_len"), "_from", sum(r["rows"] for r in found))
    laid = laid.withColumn("_to", F.col("_from") + F.col("_n") * F.col("_len"))
    pieces = laid.withColumn("_block", F.explode(F.sequence(F.expr(f"_from div {block}"), F.expr(f"(_to - 1) div {block}"))))
    slots = schedule(spark, need).join(F.broadcast(spark.createDataFrame([(i, -(-n // block)) for i, n in enumerate(sizes)], "_i int, _blocks long")), F.col("_s") == F.col("_i"))
    slots = slots.select("slot", "_s", F.expr("rank % _blocks").alias("_block"), F.expr("rank div _blocks").alias("_pass"))
    pieces = pieces.join(slots, ["_s", "_block"])
    first = F.greatest(F.col("_from"), F.col("_block") * block)
    end = F.least(F.col("_to"), (F.col("_block") + 1) * block, F.col("_most") - F.col("_pass") * F.col("_all"))
    pieces = pieces.withColumn("_words", F.greatest(end - first, F.lit(0)))
    words = pieces.groupBy("_s", "doc_id", "_id").agg(F.sum("_words").alias("_words"), F.max("_n").alias("_n"), F.min(F.when(F.col("_words") > 0, F.col("slot"))).alias("first_slot"))
    taken = words.select(F.col("_s").alias("_ts"), F.col("doc_id").alias("_td"), F.col("_id").alias("_ti"), F.expr("_words div _n").alias("taken"), "first_slot")
    # one row for each source, doc_id and text; rows equal in these have the same values
    values = items.join(taken, F.col("doc_id").eqNullSafe(F.col("_td")) & (F.col("_id") == F.col("_ti")) & (F.col("_s") == F.col("_ts")), "left")
    values = values.select(F.col("source").alias("_vs"), F.col("doc_id").alias("_vd"), F.col("_id").alias("_vi"), F.col("_len").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    out = rows.join(values, F.col("doc_id").eqNullSafe(F.col("_vd")) & (F.col("_id") == F.col("_vi")) & F.col("source").eqNullSafe(F.col("_vs")))
    return out.select(*columns(out), *MADE)


def copies(df: DataFrame) -> DataFrame:
    """Each row of mixed() as often as the words taken make up its size, rounded; rows taken less than half go.

    Of a source's documents, laid end to end, the mix takes whole passes and then a first part, which ends inside one
    document; so what rounding changes of a source's words is at most half of one document, with its repeated rows.
    """
    n = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    held, columns = carried(df, MADE)
    out = held.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), n)))
    return out.select(*(c for c, name in zip(columns(out), df.columns, strict=True) if name not in MADE))
