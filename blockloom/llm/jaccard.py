"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection of sorted arrays.

A document's set is its distinct n-word shingles as 64-bit hashes; documents with equal sets form one class, known by a
hash of the set, its node. Linked classes share a shingle among the first |set| - ceil(t |set|) + 1 of each in any fixed
order of all shingles (the prefix), so a run, the nodes that have one shingle in their prefix, is a place where pairs
meet. The order puts shingles that very many documents hold last, so passages that documents have in common start no
run unless they fill most of a document.

1. One pass over the texts gives each document's node, size and bitmap, and counts of shingles that recur within a
   batch. The HEAVY most frequent of those come last in the order; large runs of theirs are cut into parts.
2. A second pass deals (shingle, node) of the prefixes by shingle; runs with one node go.
3. Each node is compared with a few partners, the hubs of most of its runs. The hub of a run is its node whose prefix
   is shared most, which in a group of near copies is the text that the others vary. This alone joins most of a large
   group, and connected components of it are the start.
4. Only runs that hold several components are looked at further, as tiles. A run of fewer than SMALL nodes is one tile;
   runs of the same nodes are the same tile. Larger runs become tiles of BLOCK nodes a side: all runs with the same
   largest component share the tiles of its members against the other nodes, and the other nodes of a run have tiles of
   their own. So what is dealt out grows with the nodes that are not joined yet.

In 3 and 4 pairs pass the band of sizes that the similarity allows and a bitmap, the parities of shingle hashes over at
least twice as many bits as the set has members; the bits that differ bound the overlap from above. Both are tested in
numpy where the nodes of a tile, or a hub and a block of its partners, lie together. Only sets of nodes in pairs that
pass are fetched as sorted arrays, and intersected exactly; a hub's set goes once to each block of its partners.
The links close the components.

No pair of different components that share a run is left out, so the result is exact, but for collisions of 64-bit
hashes (expected: fewer than one in 10**9 documents). Links inside a component that is known already are not sought.

Defined results: a null text, or one without words, has an empty set, n_shingles 0, and its own doc_id as component;
with fewer than n words the whole sequence is the one shingle; repeated rows and equal texts share a component; rows that
share a doc_id with different texts are one document and link their groups; a null doc_id links with nothing and has a
null component; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm import text as T
from blockloom.llm.components import components
from blockloom.llm.shared import checkpoint, mapped

WORDS = 5
SIMILARITY = (75, 100)
#: Shingles counted as heavy at most, the count within a window of COUNTED bytes of text that is reported, and the
#: total from which a shingle is heavy. A run of a heavy shingle is cut into parts of about PART nodes.
HEAVY, REPORTED, LEAST, COUNTED, PART = 1 << 18, 2, 8, 8 << 20, 20_000
BLOCK = 2048
PAIRS = 1 << 22
HUBS = 3
SMALL = 48
FILTER_BITS = 24


def node_of(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def node_pass(n: int):
    """doc_id, size of the set, node and bitmap; and for shingles that recur in a window: null, count and shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def recurring():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            on = counts >= REPORTED
            return pa.RecordBatch.from_arrays([pa.nulls(int(on.sum()), pa.int64()), pa.array(counts[on].astype(np.int64)), pa.array(keys[on].astype(np.int64)), pa.array(np.ones(int(on.sum()), bool)), pa.nulls(int(on.sum()), pa.binary())], names=["doc_id", "n", "node", "recurring", "bits"])

        for batch in batches:
            for a, b, raw, off in T.slices(batch.column(1)):
                sets = T.shingles(raw, off, n)
                nodes = [node_of(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(np.zeros(b - a, bool)), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n", "node", "recurring", "bits"])
                for s, k in zip(sets, nodes, strict=True):
                    if k is not None and k not in seen:
                        seen.add(k)
                        held.append(s)
                size += len(raw)
                if size > COUNTED and held:
                    yield recurring()
                    held, size, seen = [], 0, set()
        if held:
            yield recurring()

    return run


def prefix_pass(n: int, heavy: np.ndarray, cuts: np.ndarray, share: tuple[int, int]):
    """(shingle, part, node, size) of each set's prefix; equal sets of a task count once. Part 0 is a whole run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, raw, off in T.slices(batch.column(0)):
                keys, nodes, counts, sizes = [], [], [], []
                for s in T.shingles(raw, off, n):
                    if not len(s) or (k := node_of(s)) in seen:
                        continue
                    seen.add(k)
                    want = len(s) - -(-share[0] * len(s) // share[1]) + 1
                    if len(heavy):
                        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        last = heavy[at] == s
                        s = np.concatenate([s[~last], s[last]])
                    keys.append(s[:want])
                    nodes.append(k)
                    counts.append(want)
                    sizes.append(len(s))
                if len(seen) > 1_000_000:
                    seen.clear()
                if not keys:
                    continue
                key, node = np.concatenate(keys), np.repeat(np.array(nodes, np.int64), counts)
                part = np.zeros(len(key), np.int64)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)
                    cut = (heavy[at] == key) & (cuts[at] > 1)
                    part = np.where(cut, 1 + (T.mix(node.astype(np.uint64)) % cuts[at].astype(np.uint64)).astype(np.int64), 0)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(part.astype(np.int32)), pa.array(node), pa.array(np.repeat(np.array(sizes, np.int32), counts))], names=["key", "part", "node", "n"])

    return run


def array_pass(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, raw, off in T.slices(batch.column(0)):
                sets = {node_of(s): s for s in T.shingles(raw, off, n) if len(s)}
                sets = {k: s for k, s in sets.items() if k not in seen}  # repeated rows count once
                seen.update(sets)
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], names=["node", "set"])

    return run


def arrays_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """node and set (sorted 64-bit hashes) of the documents with these ids, and of few others.

    A filter of 2**FILTER_BITS bits, as a table of 2**(FILTER_BITS - 6) words at most, keeps out most other texts, so
    that no text is shuffled.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
    docs = docs.withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(words), "word")
    docs = docs.where(F.expr("shiftrightunsigned(bits, CAST(bit % 64 AS INT)) & 1L = 1L"))
    return mapped(docs.select("text"), array_pass(n), "node long, set binary")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def by_hub(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Rows (hub, block, a, values of a), in order, for the pairs (a, b) of nodes, where b is the hub.

    A hub's own row comes first, once for each block of its pairs, with a null.
    """
    blocks = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    some = [c for c in values.columns if c != "node"]
    own = blocks.join(values.withColumnRenamed("node", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("a"), *some)
    met = pairs.join(values.withColumnRenamed("node", "a"), "a").withColumnRenamed("b", "hub").join(blocks, "hub")
    met = met.select("hub", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"), "a", *some)
    return own.unionByName(met).repartition("hub", "block").sortWithinPartitions("hub", "block", F.asc_nulls_first("a"))


def hub_pass(linked):
    """Pairs (a, b) of rows of by_hub for which linked(values of the hubs, values of the others) is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            keys, first = batch.column(0).to_numpy(), batch.column(2).is_null().to_numpy(zero_copy_only=False)
            columns = [c.to_pylist() for c in batch.columns[3:]]
            rows, hubs, theirs = [], [], []
            for i, (key, is_hub) in enumerate(zip(keys.tolist(), first.tolist(), strict=True)):
                if is_hub:
                    hub, own = key, tuple(c[i] for c in columns)
                elif hub == key:
                    rows.append(i)
                    hubs.append(own)
                    theirs.append(tuple(c[i] for c in columns))
            keep = np.array(rows, np.int64)[np.fromiter((linked(x, y) for x, y in zip(hubs, theirs, strict=True)), bool, len(rows))]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(keep)), pa.array(keys[keep])], names=["a", "b"])

    return run


def bounded(pairs: DataFrame, classes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs that sizes and bitmaps allow."""
    p, q = share

    def linked(x: tuple, y: tuple) -> bool:
        return q * min(x[0], y[0]) >= p * max(x[0], y[0]) and possible(x[0], y[0], x[1], y[1], share)

    return mapped(by_hub(pairs, classes.select("node", "n", "bits")), hub_pass(linked), "a long, b long")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity; b may be the same in many."""
    pairs = checkpoint(pairs)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    arrays = checkpoint(arrays_of(docs, classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), n))

    def linked(x: tuple, y: tuple) -> bool:
        sa, sb = np.frombuffer(x[0], np.uint64), np.frombuffer(y[0], np.uint64)
        o = overlap(sa, sb)
        return share[1] * o >= share[0] * (len(sa) + len(sb) - o)

    return mapped(by_hub(pairs, arrays), hub_pass(linked), "a long, b long")


def bitmap(s: np.ndarray) -> bytes:
    """Bit i is the parity of the shingles with hash i modulo the width, a power of two of twice the size or more."""
    width = 1 << max(6, int(2 * len(s) - 1).bit_length())
    bits = np.bincount((s % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def possible(na: int, nb: int, x: bytes, y: bytes, share: tuple[int, int]) -> bool:
    """Whether the bits that differ leave the overlap that the similarity p / q needs.

    They bound the overlap o by (na + nb - bits) / 2, and (p + q) o >= p (na + nb) is needed.
    """
    if len(x) > len(y):
        x, y = y, x
    v, size = int.from_bytes(y, "little"), 8 * len(y)
    while size > 8 * len(x):  # the upper half adds to the lower without carry
        size //= 2
        v = v >> size ^ v & (1 << size) - 1
    differ = (int.from_bytes(x, "little") ^ v).bit_count()
    p, q = share
    return (p + q) * (na + nb - differ) >= 2 * p * (na + nb)


WIDE = np.int64(1) << np.int64(40)


def banded_pairs(group: np.ndarray, n: np.ndarray, comp: np.ndarray, share: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of one group, of different components and of sizes that can be similar; PAIRS at a time."""
    r = np.lexsort((n, group))
    key = group[r] * WIDE + n[r]
    lo = np.arange(1, len(r) + 1)
    count = np.maximum(np.searchsorted(key, group[r] * WIDE + share[1] * n[r] // share[0], "right") - lo, 0)
    upto, first = np.cumsum(count), 0
    while first < len(r):
        end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
        c = count[first:end]
        x = np.repeat(r[first:end], c)
        y = r[np.repeat(lo[first:end] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))]
        on = comp[x] != comp[y]
        yield x[on], y[on]
        first = end


def grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """Columns of consecutive rows in whole groups; a group, equal in the first columns, may go on in the next batch."""
    held = None
    for batch in batches:
        v = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            v = [np.concatenate([x, y]) for x, y in zip(held, v, strict=True)]
        if not len(v[0]):
            continue
        same = np.logical_and.reduce([c == c[-1] for c in v[:by]])
        cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        held = [x[cut:] for x in v]
        if cut:
            yield [x[:cut] for x in v]
    if held is not None and len(held[0]):
        yield held


def group_starts(v: list[np.ndarray], by: int) -> np.ndarray:
    new = np.ones(len(v[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in v[:by]])
    return new


def as_batches(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(a), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(a[s : s + (1 << 18)]), pa.array(b[s : s + (1 << 18)])], names=["a", "b"])


def folded(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps brought to one width by adding their halves without carry."""
    out = np.empty((len(maps), width // 64), np.uint64)
    for i, m in enumerate(maps):
        w = np.frombuffer(m, np.uint64)
        while len(w) > width // 64:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        out[i] = w
    return out


def allowed(x: np.ndarray, y: np.ndarray, n: np.ndarray, maps: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Whether the bitmaps of the rows x and y leave the overlap that their sizes need: possible() for many pairs."""
    p, q = share
    size = np.fromiter(map(len, maps), np.int64, len(maps))
    width, keep = np.minimum(size[x], size[y]), np.zeros(len(x), bool)
    for w in np.unique(width):
        on = np.flatnonzero(width == w)
        rows = np.unique(np.concatenate([x[on], y[on]]))
        bits, step = folded(maps[rows], 8 * int(w)), max(1, (1 << 21) // int(w))
        for s in range(0, len(on), step):
            k = on[s : s + step]
            differ = np.bitwise_count(bits[np.searchsorted(rows, x[k])] ^ bits[np.searchsorted(rows, y[k])]).sum(1, dtype=np.int64)
            total = n[x[k]] + n[y[k]]
            keep[k] = (p + q) * (total - differ) >= 2 * p * total
    return keep


LEFT, RIGHT, BOTH = 0, 1, 2


def tile_pairs(n: np.ndarray, comp: np.ndarray, node: np.ndarray, side: np.ndarray, maps: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right row of a large tile, of different components, that size and bitmap allow."""
    p, q = share
    lefts, rights = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)
    band = np.floor(np.log(n) / np.log(q / p)).astype(int)
    found = [np.zeros((2, 0), np.int64)]
    for b in np.unique(band[lefts]):
        i = lefts[band[lefts] == b]
        j = rights[(n[rights] * q >= n[i].min() * p) & (n[rights] * p <= n[i].max() * q)]
        if not len(j):
            continue
        width = 8 * min(map(len, maps[np.concatenate([i, j])]))
        x, y = folded(maps[i], width), folded(maps[j], width)
        step = max(1, (1 << 21) // (len(j) * (width // 64)))
        for s in range(0, len(i), step):
            k = i[s : s + step]
            differ = np.bitwise_count(x[s : s + step, None, :] ^ y[None]).sum(2, dtype=np.int64)
            total = n[k][:, None] + n[j][None]
            fine = ((p + q) * (total - differ) >= 2 * p * total) & (comp[k][:, None] != comp[j][None])
            fine &= (q * n[k][:, None] >= p * n[j][None]) & (q * n[j][None] >= p * n[k][:, None])
            u, v = np.nonzero(fine)
            found.append(np.stack([node[k[u]], node[j[v]]]))
    both = np.unique(np.sort(np.concatenate(found, 1), 0), axis=1)
    return both[0], both[1]


def tile_pass(share: tuple[int, int]):
    """Pairs (a, b) of tiles, rows (key, i, j, n, comp, node, side, bits) in order of the first three.

    Small tiles have rows of side BOTH alone, and many of them are worked on at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in grouped(batches, 3):
            new = group_starts(v, 3)
            own = v[6] == BOTH
            if own.any():
                n, comp, node, _, maps = (c[own] for c in v[3:])
                for x, y in banded_pairs(np.cumsum(new)[own], n, comp, share):
                    on = allowed(x, y, n, maps, share)
                    if on.any():
                        yield from as_batches(*np.unique(np.sort(np.stack([node[x[on]], node[y[on]]]), 0), axis=1))
            at = np.append(np.flatnonzero(new), len(new))
            for a, b in zip(at[:-1], at[1:], strict=True):
                if not own[a]:
                    yield from as_batches(*tile_pairs(*(c[a:b] for c in v[3:]), share))

    return run


def open_tiles(runs: DataFrame, known: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (key, i, j, n, comp, node, side, bits), in order, of the tiles of runs that hold several components."""
    rows = runs.join(known, "node", "left").select("key", F.col("n").cast("long").alias("n"), F.coalesce("component", "node").alias("comp"), "node", "small")
    # a small run, of fewer than SMALL nodes, is one tile; runs of the same nodes are the same tile
    near = rows.where("small").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.array_sort(F.collect_set(F.struct("node", "n", "comp"))).alias("rows")).where("lo < hi")
    near = near.groupBy(F.xxhash64("rows.node").alias("key")).agg(F.first("rows").alias("rows")).select("key", F.inline("rows"))
    tiles = near.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "n", "comp", "node", F.lit(BOTH).alias("side"), F.lit(2).alias("kind"))

    rows = rows.where("NOT small").drop("small").distinct()
    each = rows.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"))
    rows = checkpoint(rows.join(each.where("comps > 1").drop("comps"), "key"))
    # members of the largest components against the others of all their runs
    mine = rows.where("comp = main").select(F.col("main").alias("key"), "n", "comp", "node").distinct()
    others = rows.where("comp <> main")
    met = others.select(F.col("main").alias("key"), "n", "comp", "node").distinct()
    for side in dealt(mine, met):
        tiles = tiles.unionByName(side.withColumn("kind", F.lit(0)))
    # the others of a run among themselves
    others = others.select("key", "n", "comp", "node")
    for side in dealt(others, others):
        tiles = tiles.unionByName(side.withColumn("kind", F.lit(1)))
    tiles = tiles.join(classes.select("node", "bits"), "node").withColumn("key", F.xxhash64("kind", "key"))
    return tiles.select("key", "i", "j", "n", "comp", "node", "side", "bits").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def open_pairs(runs: DataFrame, known: DataFrame, classes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of nodes of different components that share a run and can be similar by size and bitmap."""
    return mapped(open_tiles(runs, known, classes), tile_pass(share), "a long, b long").distinct()


def dealt(left: DataFrame, right: DataFrame, n_left: str = "blocks_left", n_right: str = "blocks_right") -> tuple[DataFrame, DataFrame]:
    """Rows of both sides of the tiles of each key: blocks i of the left rows by blocks j of the right ones."""
    blocks = lambda d, name: d.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    cuts = blocks(left, n_left).join(blocks(right, n_right), "key")
    own = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(cuts, "key").select("key", own(1, n_left).alias("i"), every(n_right).alias("j"), "n", "comp", "node", F.lit(LEFT).alias("side"))
    b = right.join(cuts, "key").select("key", every(n_left).alias("i"), own(2, n_right).alias("j"), "n", "comp", "node", F.lit(RIGHT).alias("side"))
    return a, b


def partners(runs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs of a node and the hubs of most of its runs, HUBS at most."""
    prefix = F.col("n") - F.ceil(F.col("n") * share[0] / share[1]) + 1
    score = runs.groupBy("node").agg((F.sum("m") / F.first(prefix)).alias("score"))
    best = runs.select("key", "node").join(score, "node").groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("hub"))
    votes = runs.select("key", "node").join(best, "key").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("c"))
    most = votes.groupBy("node").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("c", "hub")))), 1, HUBS).alias("h"))
    return most.select(F.col("node").alias("a"), F.explode("h.hub").alias("b"))


def jaccard_components(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id IS NOT NULL")
    first = checkpoint(mapped(docs, node_pass(words), "doc_id long, n long, node long, recurring boolean, bits binary"))
    everything, recurring = first.where("NOT recurring"), first.where("recurring")
    rows = everything.where("doc_id IS NOT NULL")
    top = recurring.groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "node").limit(HEAVY).collect()  # HEAVY shingles at most
    heavy = np.array([r["node"] for r in top], np.int64).astype(np.uint64)
    order = np.argsort(heavy)
    cuts = np.array([max(1, -(-r["n"] // PART)) for r in top], np.int64)[order]
    heavy = heavy[order]

    placed = mapped(named.select("text"), prefix_pass(words, heavy, cuts, share), "key long, part int, node long, n int")
    run = Window.partitionBy("key", "part")
    wide = placed.withColumns({"lo": F.min("node").over(run), "hi": F.max("node").over(run), "m": F.count("*").over(run)})
    # parts of a large run belong together, whatever one of them holds
    wide = wide.withColumn("small", (F.col("m") < SMALL) & (F.col("part") == 0))
    runs = checkpoint(wide.where("lo < hi OR part > 0").select("key", "node", "n", "m", "small"))
    del placed, wide, first
    partner = partners(runs, share)
    classes = checkpoint(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits")))
    # rows that share a doc_id
    doubled = rows.where("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b < hi")
    doubled = rows.join(doubled, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")

    known = components(verified(bounded(partner, classes, share), classes, named, words, share).unionByName(doubled))
    more = verified(open_pairs(runs, known, classes, share), classes, named, words, share)
    known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    labelled = classes.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    named_nodes = labelled.join(least, "component").select("node", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return everything.join(named_nodes, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
