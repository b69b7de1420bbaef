"""Near duplicates, mixing, sharding, archives and chats on odd rows and against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import chat, components, embeddings, jaccard, mixing, sharding, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(s):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(rows):
    """{doc_id: component} with rows that share a doc_id taken as one document."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(parent, i), root(parent, j)
                parent[max(x, y)] = min(x, y)
    return {i: root(parent, i) for i in parent}


def check_jaccard(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute_components(rows)
    got = jaccard.jaccard_components(df).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((i, len(shingles(t)), want.get(i)) for i, t in rows)


def test_jaccard_odd_rows(odd, none):
    check_jaccard(odd)
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_near_copies(spark, monkeypatch):
    """A large group of near copies, a chain, a passage in common, and small blocks, parts and windows."""
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "PART", 10)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    monkeypatch.setattr(jaccard, "SMALL", 6)
    monkeypatch.setattr(jaccard, "COUNTED", 20_000)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows, at = [], 0
    for _ in range(60):
        w = base[:]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = word()
        rows.append((at := at + 1, " ".join(w)))
    for _ in range(40):
        rows.append((at := at + 1, " ".join([word() for _ in range(rng.randint(5, 60))] + passage)))
    chain = [word() for _ in range(100)]
    for k in range(12):
        rows.append((at := at + 1, " ".join(chain[4 * k :] + [word() for _ in range(4 * k)])))
    rng.shuffle(rows)
    check_jaccard(spark.createDataFrame(rows, "doc_id long, text string"))


def test_bitmaps_never_exclude_a_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 60)), np.uint64)]))
        o = jaccard.overlap(a, b)
        assert o == len(set(a.tolist()) & set(b.tolist()))
        if len(b) and 100 * o >= 75 * (len(a) + len(b) - o):
            assert jaccard.possible(len(a), len(b), jaccard.bitmap(a), jaccard.bitmap(b), (75, 100))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5)]
    parent = {i: i for x in links for i in x}
    for a, b in links:
        x, y = root(parent, a), root(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(parent, i) for i in parent if any(j != i and root(parent, j) == root(parent, i) for j in parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, cosine=0.9):
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, parent = [0] * len(rows), {i: i for i, _ in rows if i is not None}
    for k, (i, a) in enumerate(rows):
        for m, (j, b) in enumerate(rows[:k]):
            if i is None or j is None or not fine(a) or not fine(b) or len(a) != len(b):
                continue
            x, y = np.array(a, np.float64), np.array(b, np.float64)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                n[k] += 1
                n[m] += 1
                p, q = root(parent, i), root(parent, j)
                parent[max(p, q)] = min(p, q)
    return Counter((i, c, root(parent, i) if i is not None else None) for (i, _), c in zip(rows, n, strict=True))


@pytest.mark.parametrize("clustered", [False, True])
def test_embeddings_against_brute_force(spark, monkeypatch, clustered):
    monkeypatch.setattr(embeddings, "PIVOTS", (1, 4, 16))
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 8))
    x = centres[rng.integers(0, 30, 300)] + rng.normal(size=(300, 8)) * (0.15 if clustered else 0.4)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(400 + i, rows[0][1]) for i in range(20)] + [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0, None] * 4), (504, [float("nan")] * 8), (505, [float("inf")] * 8), (506, [1.0] * 5), (507, [2.0] * 5), (None, rows[0][1]), (3, rows[3][1]), (4, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(df, tile_rows=64).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_vectors(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_unlisted_dimensions(spark):
    rng = np.random.default_rng(3)
    rows = []
    for dim, n in ((4, 60), (3, 50), (5, 40), (7, 2), (9, 1)):
        base = rng.normal(size=(max(1, n // 4), dim))
        rows += [(len(rows) + i, [float(x) for x in base[i % len(base)] + rng.normal(size=dim) * 0.05]) for i in range(n)]
    rows.append((len(rows), rows[70][1]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_vectors(rows)
    for listed in (1, 2, 5):
        got = embeddings.near_duplicates(df, tile_rows=16, listed=listed).collect()
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want


def test_mixing_targets():
    assert mixing.targets([100, 100, 100], (5, 2, 1)) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 1000, 0], (5, 2, 1)) == pytest.approx([30, 980, 0])
    assert mixing.targets([], (5,)) == [] and mixing.targets([0, 0]) == [0, 0]


def test_mixing_odd_rows(spark, odd, none):
    rows = mixing.mixed(odd, block=16).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0]["source_size"]
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 2  # repeated rows share, rounded down
    assert mixing.mixed(none).count() == 0


def test_mixing_is_exact_and_repeatable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    a = mixing.mixed(docs, block=64, drop_text=True).collect()
    b = mixing.mixed(docs.repartition(7), block=64, drop_text=True).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in a) == sorted((r["doc_id"], r["taken"]) for r in b)
    got = Counter()
    for r in a:
        got[r["source"]] += r["taken"]
    assert all(abs(got[r["source"]] - r["target"]) <= 0.5 for r in a)


def test_schedule_spreads_sources(spark):
    rows = sorted((r["slot"], r["_s"]) for r in mixing.schedule(spark, [500, 300, 200]).collect())
    assert Counter(s for _, s in rows) == {0: 500, 1: 300, 2: 200}
    head = Counter(s for _, s in rows[:100])
    assert all(abs(head[k] - n) <= 4 for k, n in ((0, 50), (1, 30), (2, 20)))
    assert mixing.schedule(spark, []).count() == 0


def test_sharding(spark, odd, none, sf):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    out = [sharding.shards(d, 7, part_rows=30).collect() for d in (docs, docs.repartition(5))]
    key = lambda rs: Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rs)
    assert key(out[0]) == key(out[1])
    by = {}
    for r in out[0]:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shards(none, 4).count() == 0


def test_communication_matrix_margins():
    m = sharding.communication_matrix([10, 0, 33, 7], 4)
    assert m.sum(1).tolist() == [10, 0, 33, 7] and sorted(m.sum(0).tolist()) == [12, 12, 13, 13]


def test_sharding_is_uniform(spark):
    """Over seeds, a row is as likely in any shard, whatever its part."""
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = Counter()
    for seed in range(12):
        for r in sharding.shards(df, 4, seed=seed, part_rows=9).collect():
            counts[r["shard"]] += r["doc_id"] < 10
    assert sum(counts.values()) == 120 and min(counts.values()) > 12


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 6000
    rows = [(1, "http://a/x y", "small"), (2, "http://a/2", "small"), (3, "u3", "r" * 2000), (9, "u9", "r" * 2000), (5, None, "r" * 2000), (9, "u9", "r" * 2000), (None, "n", "r" * 2000), (6, "u\r\nX: y", None), (7, "", big), (8, "b", big + "!"), (8, "b", big + "!")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    path = str(tmp_path / "w")
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    want = Counter()
    for i, _, html in rows:
        p = (html or "").encode()
        top = max((j for j, _, h in rows if h == html and j is not None), default=None)
        revisit = len(p) >= 1000 and top is not None and sum(h == html for _, _, h in rows) > 1 and i != top
        want[(i, "revisit" if revisit else "response", top if revisit else None, len(p), hashlib.sha1(p).hexdigest())] += 1
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    assert all(r["error"] is None for r in got)
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    assert warc.records(spark, path, True).count() >= 6
    broken = warc.records(spark, path, True).where("segment <> 2")
    assert warc.reassembled(broken).where("error IS NULL").count() == 0
    warc.write_archives(df.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_chunked_framing():
    for n in (0, 1, 4096, 4097, 20000):
        x = bytes(i % 251 for i in range(n))
        assert warc.unchunked(warc.chunked(x)) == x
    for bad in (b"", b"5\r\nabc", b"3\r\nabcde"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_chat_against_sql(spark, sf):
    odd = [(1000, 0, "user", "hi"), (1000, 1, "assistant", "yes"), (1001, 0, "user", "hi"), (1001, 1, "assistant", "no é😀"), (1002, 5, None, None), (1003, 9, None, None), (1004, 0, "user", "alone"), (1007, 0, "user", "a"), (1007, 0, "user", "a"), (None, 0, "user", "x"), (1008, None, "user", ""), (1009, 1, "user", "")]
    df = spark.read.parquet(f"{sf}/conversations.parquet").unionByName(spark.createDataFrame(odd, "conv_id long, turn int, role string, text string")).withColumn("prompt", F.lit("clash"))
    got = chat.preference_pairs(df)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    rel = con.sql(chat.ORACLE_SQL)
    assert got.columns == rel.columns
    assert Counter(map(tuple, got.collect())) == Counter(rel.fetchall())
    row = got.where("pair_id = 500").first()
    assert row["n_prompt_turns"] == 1 and row["prompt"].count("hi") == 1
    a, b = map(int, row["rejected_mask"].split("-"))
    assert row["rejected"][a:b] == "no é😀"
    assert chat.preference_pairs(df.limit(0)).count() == 0
