"""The pipeline's stages against the operators' brute force."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from blockloom.llm import mixing, secrets
from tests.llm.test_join_operators import brute_components
from tests.llm.test_text_operators import brute_quality
from blockloom.llm import quality


def passes(s):
    m = brute_quality(s)
    bad = m[0] < 50 or 100 * m[4] > 50 * m[0] or m[5] > quality.MAX_LINE_SHARE * m[1]
    return not bad and all(v <= most * m[1] for (_, most), v in zip(quality.COVERAGE, m[6:]))


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    kept = [r for r in rows if passes(r["text"])]
    got = corpus_pipeline.quality_stage(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in kept)

    groups = brute_components([(r["doc_id"], r["text"]) for r in kept])
    one = [r for r in kept if groups[r["doc_id"]] == r["doc_id"]]
    got = corpus_pipeline.near_duplicate_stage(spark, got, sf)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in one)

    got = corpus_pipeline.secret_stage(spark, got, sf)
    clean = {r["doc_id"]: secrets.redacted(r["text"], secrets.scan(r["text"])) for r in one}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == clean and got.columns == docs.columns

    mix = {(r["doc_id"]): r for r in mixing.mixed(got).collect()}
    got = corpus_pipeline.mixture_stage(spark, got, sf)
    times = Counter(r["doc_id"] for r in got.collect())
    assert got.columns == docs.columns
    assert all(times[i] == int(r["taken"] / r["size"] + 0.5) for i, r in mix.items() if r["size"])

    last = corpus_pipeline.token_stage(spark, got, sf)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    for r in last.collect()[:50]:
        assert r["ids"] == sp.encode(clean[r["doc_id"]], add_bos=True, add_eos=True)


def test_tokens_are_decoded(spark, odd, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    rows = corpus_pipeline.token_stage(spark, odd, sf).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["decoded"] == sp.decode(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_odd_rows_go_through(spark, odd, none, sf):
    for start in (odd, none):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.count()
    kept = corpus_pipeline.near_duplicate_stage(spark, odd, sf).collect()
    assert Counter(r["doc_id"] for r in kept)[1] == 1 and Counter(r["doc_id"] for r in kept)[2] == 0 and Counter(r["doc_id"] for r in kept)[None] == 2


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and "ids" in out.columns
    assert np.all([r["n_tokens"] == len(r["ids"]) for r in out.collect()])
