"""Embedding near-duplicates by an exact metric range join.

Equal vectors are merged into weighted classes first. Pivots part the unit sphere into cells of nearest pivot. A vector
whose distance to the border of another cell (the hyperplane midway between two pivots, a bound by the triangle
inequality) is at most the range is replicated into that cell, so a cell's own vectors meet all their neighbours there
and cells join independently. Cells are cut into tiles of bounded size, whatever their own; within a tile a float32
product decides all pairs but those within its rounding error of the threshold, which are decided in double precision.

How many pivots pay is estimated on a bounded sample, since in data without clusters borders are everywhere near; up to
the root of the number of classes, and the largest of PIVOTS, are tried.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different length do not link; equal vectors link with each other; rows that share a vec_id are one vector for components
and each counts its own links; a null vec_id links with nothing; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.components import components
from blockloom.llm.shared import checkpoint, tidied

COSINE = 0.9
#: Classes, and numbers in them, from which the pivots are taken, at most; and the numbers of pivots that are tried.
SAMPLE, SAMPLE_NUMBERS = 8192, 1 << 20
PIVOTS = (1, 8, 32, 128, 512, 2048)
COPY = 2000
#: Rows of a tile's side at most, and numbers in it.
TILE, TILE_NUMBERS = 16384, 1 << 22
#: Dimensions, those of the most classes, that have pivots of their own; all others are joined in one pass without pivots.
LISTED = 1000


def lists(column: pa.Array) -> np.ndarray:
    """An Arrow list column whose lists have one length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def gaps(pivots: np.ndarray) -> np.ndarray:
    """Distances between unit pivots."""
    return np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))


def near_cells(x: np.ndarray, pivots: np.ndarray, between: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of unit vectors, and whether they are in each cell (at home or as a copy).

    For unit vectors the hyperplane midway between pivots p and q goes through the origin, and a point at angle t from
    it has x.(p - q) / |p - q| = sin t; a neighbour beyond it is at an angle of t at least.
    """
    sim = x @ pivots.T
    home = sim.argmax(1)
    reach = np.sqrt(1 - cosine * cosine) + 1e-6
    inside = (sim[np.arange(len(x)), home][:, None] - sim) <= reach * (between[home] + 1e-6)
    inside[np.arange(len(x)), home] = True
    return home, inside


def steps(n: int, pivots: int) -> Iterator[slice]:
    """Parts of n rows whose tables of all pivots have a bounded size."""
    step = max(64, (1 << 20) // pivots)
    return (slice(a, a + step) for a in range(0, n, step))


def choose_pivots(sample: np.ndarray, cosine: float, n: int) -> np.ndarray:
    """As many pivots, up to the root of the number n of classes, as make the least work by the sample.

    Work is counted in pairs to look at; a copy in another cell costs as much as COPY of them.
    """
    best, cost = sample[:1], None
    for k in PIVOTS:
        if k > 1 and (k * 4 > len(sample) or k * k > n):
            break
        pivots, between = sample[:k], gaps(sample[:k])
        homes, alls = np.zeros((2, k))
        for part in steps(len(sample), k):
            home, inside = near_cells(sample[part], pivots, between, cosine)
            homes += np.bincount(home, minlength=k)
            alls += inside.sum(0)
        now = (homes * alls).sum() / len(sample) ** 2 * n + COPY * alls.sum() / len(sample)
        if cost is None or now < 0.8 * cost:
            best, cost = pivots, now
    return best


def tile(left: np.ndarray, right: np.ndarray, keys: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray], weights: tuple[np.ndarray, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """For each left and each right row the summed weight of the rows of the other side linked with it, and links of ids
    that connect all that are.

    Rows with equal keys are the same class and do not count.
    """
    lu, ru = unit(left), unit(right)
    l32, r32 = lu.astype(np.float32), ru.astype(np.float32)
    slack = 1e-4 + 1e-6 * left.shape[1]
    totals = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    label = np.arange(len(left) + len(right))  # of left rows, then right rows: the smallest index reached in this tile
    rows, cols = [], []
    for s in range(0, len(left), 512):
        sim = l32[s : s + 512] @ r32.T
        some = np.flatnonzero(sim.max(1) >= cosine - slack)  # most rows are near none
        if not len(some):
            continue
        sim = sim[some]
        some = some + s
        mask = sim >= cosine
        i, j = np.nonzero(np.abs(sim - np.float32(cosine)) <= slack)
        if len(i):
            mask[i, j] = np.einsum("ij,ij->i", lu[some[i]], ru[j]) >= cosine
        mask &= keys[0][some][:, None] != keys[1][None]
        totals[0][some] = mask @ weights[1]
        totals[1][:] += weights[0][some] @ mask
        i, j = np.nonzero(mask)
        rows.append(some[i].astype(np.int32))
        cols.append(j.astype(np.int32))
        if sum(map(len, rows)) > 2_000_000:
            settle(label, np.concatenate(rows), np.concatenate(cols) + len(left))
            rows, cols = [], []
    if rows:
        settle(label, np.concatenate(rows), np.concatenate(cols) + len(left))
    ids = np.concatenate(ids)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return *totals, [*zip(ids[moved].tolist(), ids[label[moved]].tolist(), strict=True)]


def settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers labels until both ends of every link have the same: hooks roots onto smaller ones and shortens paths."""
    while len(i):
        li, lj = label[i], label[j]
        differ = li != lj
        if not differ.any():
            return
        i, j, li, lj = i[differ], j[differ], li[differ], lj[differ]
        np.minimum.at(label, np.maximum(li, lj), np.minimum(li, lj))
        while True:
            short = label[label]
            if np.array_equal(short, label):
                break
            label[:] = short


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tile_rows: int = TILE, listed: int = LISTED) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"), F.coalesce(fine, F.lit(False)).alias("fine"))
    rows = rows.withColumns({"k1": F.when(F.col("fine"), F.xxhash64("embedding")), "k2": F.when(F.col("fine"), F.xxhash64(F.lit(1), "embedding"))})
    good = rows.where("fine")
    classes = checkpoint(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("v")).withColumn("dim", F.size("v")))
    made = []
    counts = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(listed + 1).collect()}
    dims = list(counts)
    for dim in sorted(dims[:listed]):
        made.append(links_of(classes.where(F.col("dim") == dim), cosine, max(1, min(tile_rows, TILE_NUMBERS // dim)), dim, counts[dim]))
    if len(dims) > listed:
        made.append(rare_links(classes.where(~F.col("dim").isin(dims[:listed])), cosine, tile_rows))
    found = made[0] if made else spark.createDataFrame([], "a long, b long, c long, w long")
    for x in made[1:]:
        found = found.unionByName(x)
    # a, b: links that connect; a, c: the class with k1 = c has w more links
    found = checkpoint(found)
    sums = found.where("b IS NULL").groupBy(F.col("a").alias("k1"), F.col("c").alias("k2")).agg(F.sum("w").alias("w"))
    own = classes.select("k1", "k2", "rep", "n").join(sums, ["k1", "k2"], "left")
    # rows that share a vec_id and not their vector connect too
    doubled = good.select("vec_id", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    ends = components(found.where("b IS NOT NULL").select("a", "b").unionByName(doubled))
    out = rows.select("vec_id", "k1", "k2").join(own.select("k1", "k2", "n", "w"), ["k1", "k2"], "left")
    out = out.join(ends, F.col("vec_id") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("w", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: Sides of a row in a tile: at home on the left, at home on the right, a copy (right), and at home on both sides.
LEFT, RIGHT, COPIED, BOTH = 0, 1, 2, 3


def joined(table: pa.Table, cosine: float) -> pa.Table:
    """Links and weights of one tile. Rows at home get their weights; copies get theirs in their own cells."""
    side = table["side"].to_numpy()
    parts = [table.take(pa.array(np.flatnonzero(np.isin(side, of)))) for of in ((LEFT, BOTH), (RIGHT, COPIED, BOTH))]
    links, keys, sums = [], [], []
    if all(t.num_rows for t in parts):
        x, y = (lists(t["v"].combine_chunks()) for t in parts)
        column = lambda c: tuple(t[c].to_numpy() for t in parts)
        mine, theirs, links = tile(x, y, column("k1"), column("rep"), column("n"), cosine)
        for t, total, of in zip(parts, (mine, theirs), ((LEFT, BOTH), (RIGHT,)), strict=True):
            on = np.flatnonzero((total > 0) & np.isin(t["side"].to_numpy(), of))
            keys.append(np.stack([t["k1"].to_numpy()[on], t["k2"].to_numpy()[on]], 1))
            sums.append(total[on])
    keys, sums = (np.concatenate(keys), np.concatenate(sums)) if keys else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    none = [None] * len(links)
    return pa.table({
        "a": pa.array([*(x for x, _ in links), *keys[:, 0].tolist()], pa.int64()), "b": pa.array([*(y for _, y in links), *[None] * len(keys)], pa.int64()),
        "c": pa.array([*none, *keys[:, 1].tolist()], pa.int64()), "w": pa.array([*none, *sums.tolist()], pa.int64()),
    })


def rare_links(classes: DataFrame, cosine: float, tile_rows: int) -> DataFrame:
    """As links_of, for classes of any dimensions at once: a dimension is one cell, cut into tiles, without pivots."""
    most = F.greatest(F.lit(1), F.least(F.lit(tile_rows), F.expr(f"{TILE_NUMBERS} div dim")))
    cuts = classes.groupBy("dim").agg(F.count("*").alias("_n")).select("dim", F.ceil(F.col("_n") / most).alias("_cuts"))
    rows = classes.join(cuts, "dim")
    own, step = F.pmod("k1", "_cuts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1))
    kept = ("k1", "k2", "rep", "n", "v")
    homes = rows.select("dim", own.alias("h"), step.alias("a"), F.lit(LEFT).alias("side"), *kept)
    copies = rows.select("dim", step.alias("h"), own.alias("a"), F.lit(COPIED).alias("side"), *kept)
    return homes.unionByName(copies).groupBy("dim", "h", "a").applyInArrow(lambda table: joined(table, cosine), "a long, b long, c long, w long")


def links_of(classes: DataFrame, cosine: float, tile_rows: int, dim: int, n: int) -> DataFrame:
    """Connecting links (a, b) and summed weights (a, c, w by class key) of the n classes of one dimension.

    The rows at home in a cell are cut into blocks by their key; a tile has two of these blocks, or one with a block of
    copies, so a pair of rows at home is looked at once, for both.
    """
    taken = classes.orderBy("k1", "k2").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // dim))).select("v").collect()  # bounded rows
    pivots = choose_pivots(unit(np.array([r["v"] for r in taken], np.float64)), cosine, n)
    between = gaps(pivots)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for part in steps(batch.num_rows, len(pivots)):
                rows = batch.slice(part.start, part.stop - part.start)
                yield rows, *near_cells(unit(lists(rows.column("v"))), pivots, between, cosine)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(pivots)), np.int64)
        for _, home, inside in cells(batches):
            counts += [np.bincount(home, minlength=len(pivots)), inside.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots), dtype=np.int32)), pa.array(counts[0]), pa.array(counts[1])], names=["cell", "homes", "alls"])

    sizes = classes.select("v").mapInArrow(counted, "cell int, homes long, alls long").groupBy("cell").agg(F.sum("homes").alias("h"), F.sum("alls").alias("a")).collect()  # a row for each pivot
    blocks = np.ones((len(pivots), 2), np.int64)
    for r in sizes:
        blocks[r["cell"]] = [max(1, -(-r["h"] // tile_rows)), -(-(r["a"] - r["h"]) // tile_rows)]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, home, inside in cells(batches):
            k = batch.column("k1").to_numpy().astype(np.uint64) >> np.uint64(1)
            row, cell = np.nonzero(inside)
            at_home, n_home, n_copied = home[row] == cell, blocks[cell, 0], blocks[cell, 1]
            own = (k[row] % np.where(at_home, n_home, np.maximum(n_copied, 1)).astype(np.uint64)).astype(np.int64)
            # a row at home is on the left of tiles with the later blocks and all copies, on the right of those with the
            # earlier blocks, and on both sides of its own block's tile; a copy is on the right of tiles with all blocks
            times = n_home + np.where(at_home, n_copied, 0)
            pick = np.repeat(np.arange(len(row)), times)
            other = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
            mine, here = own[pick], at_home[pick]
            left = here & (other > mine)
            h = np.where(here & ~left, other, np.where(left, mine, other))
            a = np.where(left, other, np.where(here, mine, n_home[pick] + mine))
            side = np.where(~here, COPIED, np.where(left, LEFT, np.where(other == mine, BOTH, RIGHT)))
            for s in range(0, len(pick), 8192):
                p = slice(s, s + 8192)
                part = batch.take(pa.array(row[pick[p]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[p].astype(np.int32)) for x in (cell[pick], h, a, side)] + [part.column(c) for c in ("k1", "k2", "rep", "n", "v")],
                    names=["cell", "h", "a", "side", "k1", "k2", "rep", "n", "v"],
                )

    tiles = classes.select("k1", "k2", "rep", "n", "v").mapInArrow(tidied(dealt), "cell int, h int, a int, side int, k1 long, k2 long, rep long, n long, v array<double>")
    return tiles.groupBy("cell", "h", "a").applyInArrow(lambda table: joined(table, cosine), "a long, b long, c long, w long")
