"""The dealt methods recomputed by plain loops, and shown to run; columns with clashing names."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from blockloom.llm import chat, embeddings, jaccard, langid, mixing, oracles, queries, quality, secrets, sharding, shared
from blockloom.llm import text as T
from tests.llm.test_join_operators import WORD, brute_components, brute_vectors, check_jaccard

INTERNAL = ("size", "kept", "spans", "_s", "_cell", "_size", "_id", "_take", "_key", "_v", "_part", "_local", "_final", "_letter", "_copy", "_carried", "_row", "_group", "a b", "a.b", "n_words", "taken", "shard")


def clashing(df):
    """df with columns that have the names of results and of what operators use inside."""
    return df.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")).alias(c) for c in INTERNAL))


def untouched(rows, names=INTERNAL):
    return all(r[c] == f"{c}:{r['doc_id'] or 0}" for r in rows for c in names)


def test_operators_carry_clashing_columns(odd, sf):
    df = clashing(odd)
    mix = mixing.mixed(df)
    assert untouched(mix.collect(), [c for c in INTERNAL if c not in mixing.MADE])
    assert mixing.copies(mix).count() > 0 and untouched(mixing.copies(mix).collect(), [c for c in INTERNAL if c not in mixing.MADE])
    assert untouched(sharding.shards(df, 3).collect(), [c for c in INTERNAL if c not in sharding.MADE])
    assert untouched(langid.predict(df, langid.learn(odd.select("lang", "text"))).collect())
    assert untouched(langid.predict(df, None).collect())
    plain = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(odd).collect()}
    assert plain == {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df.withColumn("node", F.lit(1))).collect()}


def test_embeddings_ignore_clashing_columns(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"k1": F.lit("x"), "n": F.lit("x"), "component": F.lit("x")})
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()) == brute_vectors(rows)


def test_stages_carry_clashing_columns(odd, none, spark, sf):
    for df in (clashing(odd), clashing(spark.read.parquet(f"{sf}/documents.parquet")), clashing(none)):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == df.columns and untouched(docs.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_different_texts_of_one_id_stay(spark, sf):
    rows = [(1, "a b c"), (2, "d e f"), (2, "other text"), (3, "A b C"), (5, "d e f"), (4, None), (4, None), (6, ""), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()))
    assert got == Counter([(1, "a b c"), (2, "d e f"), (2, "other text"), (4, None), (6, ""), (7, "")])


def test_repeated_rows_leave_one_that_is_determined(spark, sf):
    rows = [(1, "same text", x) for x in "dbca"]
    for n in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n)
        assert [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()] == [(1, "same text", "a")]


def test_chat_of_large_ids(spark):
    big = 1 << 60
    rows = [(big + k, t, "user" if t % 2 == 0 else "assistant", f"{k // 2} {t}" if t < 2 else f"{k}") for k in range(6) for t in range(3)]
    got = chat.preference_pairs(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert sorted((r["pair_id"], r["chosen_id"], r["rejected_id"], r["n_prompt_turns"]) for r in got) == [((big >> 1) + k, big + 2 * k, big + 2 * k + 1, 2) for k in range(3)]


def test_mismatched_replies_against_sql(spark, sf):
    odd = [(1000, 0, "user", "hi"), (1000, 1, "assistant", "yes"), (1001, 0, "user", "hi"), (1001, 1, "assistant", "no é😀"), (1001, 1, "assistant", "no é😀"), (1002, 5, None, None), (1004, None, "assistant", None), (1005, 2, "assistant", "x"), (1005, 2, "assistant", "y"), (None, 1, "user", "x"), (1006, 1, "assistant", "z")]
    df = spark.read.parquet(f"{sf}/conversations.parquet").unionByName(spark.createDataFrame(odd, "conv_id long, turn int, role string, text string"))
    got = chat.preference_pairs(chat.mismatched_replies(df.withColumns({"pair_id": F.lit("clash"), "side": F.lit(9)})), F.col("pair_id"), F.col("side"))
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    rel = con.sql(oracles.ORACLES["op2_chat_formatting"])
    assert got.columns == rel.columns
    assert Counter(map(tuple, got.collect())) == Counter(rel.fetchall())
    row = got.where("pair_id = 1000").first()
    assert row["prompt"].count("hi") == 1 and "yes" in row["chosen"] and "no é😀" in row["rejected"] and row["n_prompt_turns"] == 1


def test_most_prompts_of_the_query_hold_turns(spark, sf):
    rows = queries.op2_chat_formatting(spark, sf).collect()
    assert sum(r["prompt"] != "" for r in rows) > 0.5 * len(rows) > 0


def test_sharding_recomputed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in sharding.shards(docs, 40).collect()}
    seed, ids = sharding.SEED, ["doc_id", "text_crc32", "size"]
    base = spark.createDataFrame([(r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16) for r in docs.collect()], "doc_id long, text_crc32 long, size long")
    keyed = base.select("*", *(F.xxhash64(F.lit(seed + k), *ids).alias(f"h{k}") for k in (1, 2, 3))).collect()
    parts: dict[int, list] = {p: [] for p in range(40)}  # as many as shards, for so few rows
    for r in keyed:
        parts[r["h1"] % 40].append(r)
    matrix = sharding.communication_matrix([len(parts[p]) for p in range(40)], 40, seed)
    assert (matrix > 0).sum() > 100 and matrix.sum(0).max() - matrix.sum(0).min() <= 1
    shards: dict[int, list] = {}
    for p, rows in parts.items():
        rows.sort(key=lambda r: ((r["h2"] % 2**64) >> 1, r["doc_id"]))
        for r, s in zip(rows, np.repeat(np.arange(40), matrix[p]).tolist(), strict=True):
            shards.setdefault(s, []).append(r)
    for s, rows in shards.items():
        rows.sort(key=lambda r: ((r["h3"] % 2**64) >> 1, r["doc_id"]))
        for slot, r in enumerate(rows):
            x = got[r["doc_id"]]
            assert (x["shard"], x["slot"], x["text_crc32"], x["size"], x["law"]) == (s, slot, r["text_crc32"], r["size"], "rows")


def test_mixing_recomputed(spark, sf):
    block = 64
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    got = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mixed(docs, block=block).collect()}
    rows = docs.select("doc_id", "source", "text", F.xxhash64(F.lit(mixing.SEED), "doc_id", F.xxhash64("text")).alias("h")).collect()
    names = sorted({r["source"] for r in rows})
    laid = {s: [] for s in names}
    for r in sorted(rows, key=lambda r: ((r["h"] % 2**64) >> 1, r["doc_id"])):
        laid[r["source"]] += [r["doc_id"]] * len(WORD.findall(r["text"] or ""))
    sizes = [len(laid[s]) for s in names]
    most = [round(t) for t in mixing.targets(sizes)]
    need = [k // n * -(-n // block) + -(-(k % n) // block) for k, n in zip(most, sizes, strict=True)]
    edges, ranks, order = np.cumsum(need)[:-1] / sum(need), Counter(), []
    for i in range(sum(need)):  # the golden-ratio points, and what they left short
        s = int(np.searchsorted(edges, (i * mixing.GOLDEN + 0.5) % 1.0, "right"))
        if ranks[s] < need[s]:
            order.append((i, s, ranks[s]))
        ranks[s] += 1
    order += [(sum(need) + r * len(need) + s, s, r) for s in range(len(need)) for r in range(ranks[s], need[s])]
    taken, first = Counter(), {}
    for slot, s, rank in sorted(order):
        words, n_blocks = laid[names[s]], -(-sizes[s] // block)
        left = most[s] - rank // n_blocks * sizes[s]  # of this pass
        for at in range(rank % n_blocks * block, min(sizes[s], (rank % n_blocks + 1) * block, left)):
            taken[words[at]] += 1
            first.setdefault(words[at], slot)
    assert got == {r["doc_id"]: (taken[r["doc_id"]], first.get(r["doc_id"])) for r in rows}


def test_copies_keep_near_the_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    mix = mixing.mixed(docs)
    rows = mix.collect()
    words = Counter()
    for r in mixing.copies(mix).collect():
        words[r["source"]] += len(WORD.findall(r["text"] or ""))
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(words[s] - own[0]["target"]) <= 0.5 + max(r["size"] for r in own) / 2


def naive_features(s):
    raw = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in s.encode())
    out = np.zeros(langid.DIM)
    for k, n in enumerate(langid.ORDERS):
        counts = Counter()
        for i in range(len(raw) - n + 1):
            h = 0
            for b in raw[i : i + n]:
                h = (h * int(T.BASE) + b) % 2**64
            counts[(h * int(T.MULT) % 2**64) >> (64 - langid.BITS)] += 1
        norm = sum(counts.values()) ** 0.5
        for at, c in counts.items():
            out[(k << langid.BITS) + at] = (c / norm**2) ** 0.5 / len(langid.ORDERS) ** 0.5
    return out


def test_language_id_recomputed(spark, odd, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(~langid.held_out()).select("lang", "text"))
    assert len(model.langs) == 4 and model.code.shape == (4, 7)
    some = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text").orderBy("doc_id").limit(40))
    for r in langid.predict(some, model).collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        bits = [sum(x * w for x, w in zip(naive_features(r["text"]), model.weights[:, j])) + model.bias[j] for j in range(7)]
        losses = [sum(w * np.log1p(np.exp(-model.sharp * b * c)) for b, c, w in zip(bits, word, model.bit_weight)) for word in model.code.tolist()]
        share = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
        top = np.sort(share)[::-1]
        assert r["score"] == pytest.approx(top[0], abs=1e-4)
        if top[0] - top[1] > 1e-3:
            assert r["lang_pred"] == model.langs[int(share.argmax())]
        if abs(top[0] - top[1] - langid.AMBIGUOUS) > 1e-3:
            assert r["ambiguous"] == (top[0] - top[1] < langid.AMBIGUOUS)


def test_language_id_fit_solves_the_ridge():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 30)).astype(np.float32), rng.integers(0, 3, 200)
    model = langid.fit(x, y, ["a", "b", "c"])
    weight = (1 / np.bincount(y))[y]
    weight *= len(y) / weight.sum()
    target = langid.codewords(3)[y].astype(float)
    error = x @ model.weights + model.bias - target
    assert np.abs((weight[:, None] * error).mean(0)).max() < 1e-4  # the bias
    mean = np.average(x, 0, weight)
    slope = (x - mean).T @ (weight[:, None] * error) + langid.RIDGE * len(y) * model.weights
    assert np.abs(slope).max() < 1e-2


def test_language_id_ties_go_to_the_first():
    model = langid.Model(["a", "b"], np.ones((2, 3), np.int8), np.zeros((langid.DIM, 3), np.float32), np.zeros(3, np.float32), np.ones(3), 4.0)
    best, score, lead = model.predict(np.zeros((1, langid.DIM), np.float32))
    assert best.tolist() == [0] and score.tolist() == [0.5] and lead.tolist() == [0.0]


def naive_novel(s, words):
    """Tokens that stand alone, parted by blanks, by a plain loop."""
    spans, out = [(m.start(), m.end()) for m in re.finditer(r"\S+", s)], []
    ends = [m.end() for m in secrets.SENSITIVE.finditer(s)]
    for a, b in spans:
        if b - a < 16 or not any(e <= a < e + secrets.CONTEXT for e in ends):
            continue
        near = (s[max(0, a - 256) : a] + s[b : b + 256]).encode()
        held = zstandard.ZstdCompressionDict(secrets.IDENTIFIERS + b"\n" + words + b"\n" + near, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        cost = lambda x: len(zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x.encode()))  # noqa: B023, E731
        parts = [s[a:b], *(s[i : i + 48] for i in [*range(a, b - 48, 24), b - 48] if b - a > 48)]
        if any((cost(p) - cost("")) / len(p) > 0.9 for p in parts):
            out.append((a, 3, b))
    return out


def test_novel_spans_by_a_plain_loop():
    rng = random.Random(12)
    pool = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_"
    prose = [" ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 9))) for _ in range(4)) for _ in range(50)]
    words = b"interesting relations stations"
    n = 0
    for _ in range(400):
        bits = [rng.choice([rng.choice(prose), "the secret is", "bearer", "auth", "credential", "".join(rng.choice(pool) for _ in range(rng.randint(10, 90))), "example_configuration_default", "interestingrelationsstations", "QwErTyUiOpAsDfGhJkLzXcVbNm"]) for _ in range(rng.randint(1, 12))]
        s = " ".join(bits)
        base = secrets.base_spans(s, s.lower())
        if base or re.search(r"(?i)\S(pass|secret|token|api|credential|auth|bearer|key|signature)|(pass\w*|secret|token|key|credential|auth|bearer|signature)[^\s]", s):
            continue
        want = naive_novel(s, words)
        n += len(want)
        assert secrets.scan(s, words) == want, s
    assert n > 50


def test_letters_alone_are_judged_by_novelty():
    s = "the secret is QwErTyUiOpAsDfGhJkLzXcVbNm"
    assert [s[a:b] for a, _, b in secrets.scan(s)] == ["QwErTyUiOpAsDfGhJkLzXcVbNm"]


def test_dictionary_comes_from_all_documents(spark):
    """Words near sensitive words in different places enter it, so do not those of copies of one place."""
    rows = [(f"number {i} internationalization_settings_loader of the token bucket internationalization_settings_loader",) for i in range(5)]
    rows += [("the secret is qwertzuiopasdfghjkyx and so on",)] * 50 + [("far from it: unrelatedword",)] * 9 + [(None,)]
    docs = spark.createDataFrame(rows, "text string").repartition(7)
    words = secrets.identifiers(docs).split()
    assert b"settings" in words and b"bucket" in words and b"unrelatedword" not in words and b"qwertzuiopasdfgh" not in words
    s = "a token handed to LoaderSettingsBucketNumberBucket here"
    assert secrets.scan(s) and not secrets.scan(s, b" ".join(words) + b" LoaderSettings BucketNumber")
    found = secrets.secrets(spark.createDataFrame([(1, "token = 0123456789abcdef0123456789abcdef"), (2, "plain")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [len(x["novelty"].split(",")) if x["spans"] else 0 for x in found] == [2, 0]  # base spans are measured too


def test_every_open_run_becomes_a_tile(spark, sf, monkeypatch):
    """On the registered table the links of the tiles are needed, and there are tiles of all kinds on planted data."""
    made = []
    real = jaccard.open_tiles
    monkeypatch.setattr(jaccard, "open_tiles", lambda *a: made.append(real(*a)) or made[-1])
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    jaccard.jaccard_components(docs).count()
    assert made[0].select("key", "i", "j").distinct().count() > 100
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(40)]
    rows = [(k, " ".join([word() for _ in range(9)] + passage + [word() for _ in range(rng.randint(1, 9))])) for k in range(40)]
    check_jaccard(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["side"] for r in made[-1].select("side").distinct().collect()} <= {jaccard.LEFT, jaccard.RIGHT, jaccard.BOTH}


def test_pivots_save_work_on_clusters():
    rng = np.random.default_rng(1)
    centres = embeddings.unit(rng.normal(size=(200, 64)))
    x = embeddings.unit(centres[rng.integers(0, 200, 6000)] + 0.02 * rng.normal(size=(6000, 64)))
    counts = []
    for n in (1_000, 100_000, 10_000_000):
        pivots = embeddings.choose_pivots(x, 0.9, n)
        home, inside = embeddings.near_cells(x, pivots, embeddings.gaps(pivots), 0.9)
        k = len(pivots)
        counts.append((k, (np.bincount(home, minlength=k) * inside.sum(0)).sum() / len(x) ** 2))
    assert counts[0][0] <= counts[1][0] <= counts[2][0] and counts[2][0] >= 128 and counts[2][1] < 0.3
    flat = embeddings.unit(rng.normal(size=(6000, 64)))
    assert len(embeddings.choose_pivots(flat, 0.9, 10**6)) == 1  # no border prunes there


def test_embeddings_in_many_tiles(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(v) for v in centres[i % 40] + 0.05 * rng.normal(size=16)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for n in (17, 100_000):
        assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df, tile_rows=n).collect()) == brute_vectors(rows)


def test_stage_near_duplicates_agrees_with_components(spark, odd, sf):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id IS NOT NULL").collect()]
    groups = brute_components(rows)
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, odd.where("doc_id IS NOT NULL"), sf).collect()]
    assert sorted(kept) == sorted(set(groups.values()))
    assert quality.quality(odd).count() == odd.count()


def test_batches_are_bounded_in_bytes(spark):
    """Texts go through Python in batches of some megabytes, unless the session has set a bound."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    def most():
        rows = spark.range(0, 2_000, 1, 1).select(F.repeat(F.lit("word "), 2_000).alias("text"))
        return max(r["n"] for r in shared.mapped(rows, sizes, "n long").collect())

    name, before = shared.BATCH_SETTING, spark.conf.get(shared.BATCH_SETTING, None)
    try:
        spark.conf.unset(name)
        assert most() < 2 * shared.BATCH_BYTES
        spark.conf.set(name, "1m")
        assert most() < 2 << 20 and spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
