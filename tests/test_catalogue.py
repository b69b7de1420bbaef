"""Every query against its SQL on the smallest tables; rows-only queries for what they must hold."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from blockloom.plans import catalogue

@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


def test_streaming_agrees_with_batch(spark, sf):
    from blockloom.operators import dedupe

    want = dedupe.references(catalogue.blocks(spark, sf, catalogue.BLOCK)).where("kind = 'literal'").count()
    got = catalogue.streaming_dedupe(spark, sf)
    assert got.where("kind = 'literal'").count() == want
    assert got.count() == catalogue.blocks(spark, sf, catalogue.BLOCK).count()


def test_patches_fit(spark, sf):
    rows = catalogue.delta_saving(spark, sf).collect()
    assert rows and all(r["fits"] for r in rows)


def test_every_block_with_a_candidate_has_a_patch(spark, tmp_path):
    import random

    rng = random.Random(5)
    a, b, c = ("".join(rng.choice("abcdefghij klmnop") for _ in range(catalogue.BLOCK)) for _ in range(3))
    rows = [(1, a + b), (2, b + c), (3, b.upper()), (4, c + a), (5, b + "x")]  # most stand at another position
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(r["doc_id"], r["segment_id"]) for r in catalogue.segment_candidates(spark, str(tmp_path)).collect()}
    got = catalogue.delta_saving(spark, str(tmp_path)).collect()
    assert {(2, 0), (4, 0), (4, 1), (5, 0)} <= want
    assert {(r["doc_id"], r["block_no"]) for r in got} == want and len(got) == len(want)
    assert all(r["fits"] and r["used"] for r in got)


def test_similar_blocks_are_found(spark):
    from pyspark.sql import functions as F

    from blockloom.operators import chunking, similarity

    a = bytes(range(256)) * 8
    b = bytearray(a)
    b[120:128] = b"\xff" * 7 + b"\x7f"  # one of the largest words, which the sketch leaves out
    df = spark.createDataFrame([(1, a), (2, bytes(b)), (3, a)], "stream_id long, data binary")
    blocks = chunking.fixed_blocks(df, 2048, keep_data=True)
    found = similarity.similar_blocks(similarity.with_sketch(blocks, 2048)).collect()
    assert [(r["stream_id"], r["ref_stream"]) for r in found] == [(2, 1)]
    assert blocks.agg(F.countDistinct("cksum")).first()[0] == 2


def test_compressed_sizes_name_substitutes(spark, sf):
    rows = {(r["codec_requested"], r["codec_used"]) for r in catalogue.compressed_size_by_codec(spark, sf).collect()}
    assert ("ppmd", "lzma") in rows and ("ppmd", "ppmd") not in rows


def test_stride_and_cuts(spark, sf):
    assert {r["stride"] for r in catalogue.stride_choice(spark, sf).collect()} <= set(range(2, 9))
    cuts = catalogue.type_change_cuts(spark, sf).collect()
    assert all(r["bytes"] >= 0 and r["n"] > 0 for r in cuts)


def test_all_candidates_are_ranked(spark):
    from pyspark.sql import functions as F

    from blockloom.operators import dictionary

    n = 110_000  # more than were ranked once; ties in weight, and in weight and length
    rows = spark.range(n).select(F.format_string("w%07d", "id").alias("word"), (F.lit(600) + F.col("id") * 7919 % 900).alias("n"), F.lit(8).cast("long").alias("len"))
    rows = rows.unionByName(spark.createDataFrame([("long word", 4501, 2)], "word string, n long, len long"))  # saves nothing at its rank
    rows = rows.withColumn("weight", (F.col("n") - 1) * (F.col("len") - 1))
    want, total = [], 0
    for rank, r in enumerate(sorted(rows.collect(), key=lambda r: (r["weight"], r["len"], r["word"].encode()), reverse=True)):
        saving = r["n"] * r["len"] - r["len"] - r["n"] * (1 if rank == 0 else 2 if rank < 217 else 3 if rank < 217**2 else 4)
        if saving > 0:
            total += saving
            want.append((r["word"], rank, saving, total))
    got = dictionary.ranked(rows).select("word", "rank", "saving", "total_saving").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want and len(want) == n
