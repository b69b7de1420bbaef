"""Round trips and invariants of the byte kernels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.config import Config, aligned_chunk, index_bytes, parse_size, segment_blocks
from blockloom.operators import chunking, codecs, delta, dictionary

some = st.one_of(
    st.binary(max_size=3000),
    st.builds(lambda b, n: b * n, st.binary(min_size=1, max_size=40), st.integers(1, 200)),
    st.builds(lambda a, d, n, s: b"".join(((a + d * i) % (1 << 8 * s)).to_bytes(s, "little") for i in range(n)), st.integers(0, 255), st.integers(0, 300), st.integers(0, 900), st.sampled_from([2, 4, 8])),
)


def scalar_candidates(x: bytes) -> list[int]:
    out = []
    for i in range(chunking.WINDOW, len(x)):
        h = 0
        for c in x[i - chunking.WINDOW + 1 : i + 1]:
            h = (h * chunking.MULTIPLIER + c) & chunking.MASK
        if h ^ int(chunking.LEAVING[x[i - chunking.WINDOW]]) == 0:
            out.append(i)
    return out


@settings(max_examples=40, deadline=None)
@given(some)
def test_cut_test_equals_a_scalar_form(x):
    assert chunking.cut_candidates(np.frombuffer(x, np.uint8)).tolist() == scalar_candidates(x)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(0, 40_000), st.integers(0, 3))
def test_blocks_cover_the_stream(seed, n, bits):
    x = np.random.default_rng(list(seed)).integers(0, 256, n, np.uint8)
    low, high = chunking.limits(bits, False)
    ends = chunking.choose_cuts(chunking.cut_candidates(x), n, low, high)
    sizes = np.diff([0, *ends])
    assert (ends[-1] if ends else 0) == n
    assert all(low <= s <= high for s in sizes[:-1])


def test_an_edit_moves_only_cuts_nearby():
    x = np.random.default_rng(1).integers(0, 256, 200_000, np.uint8)
    y = np.concatenate([np.array([7], np.uint8), x])
    cuts = lambda v: {e - len(v) for e in chunking.choose_cuts(chunking.cut_candidates(v), len(v), *chunking.limits(0, False))}
    a, b = cuts(x), cuts(y)
    assert len(a & b) > 0.9 * len(a)


@settings(max_examples=80, deadline=None)
@given(some)
def test_series_zero_lzp_transpose_round_trip(x):
    made = delta.series_encode(x)
    assert made is None or delta.series_decode(made) == x and len(made) < len(x)
    assert delta.zero_decode(delta.zero_encode(x)) == x
    made = codecs.lzp_encode(x)
    assert made is None or codecs.lzp_decode(made) == x
    for s in (2, 3, 8):
        assert delta.transpose(delta.transpose(x, s), s, back=True) == x
    assert codecs.call_encode(codecs.call_encode(x), True) == x or b"\xe8" in x or b"\xe9" in x


def test_series_shrink():
    x = b"".join((5 * i).to_bytes(8, "little") for i in range(4000))
    assert len(delta.series_encode(x)) < len(x) // 50


@settings(max_examples=60, deadline=None)
@given(some, some, st.integers(0, 3000))
def test_patch_makes_the_new(a, b, at):
    for old, new in ((a, b), (a, a[:at] + b + a[at:]), (b"", a), (a, b"")):
        assert delta.patch(old, delta.diff(old, new)) == new


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=500), st.text("theTHE 0123456789,.é\x02", max_size=300).map(str.encode)))
def test_dictionary_round_trip(x):
    words = [b"the", b"hehe", b"tttt"]
    assert dictionary.decode(dictionary.encode(x, {w: i for i, w in enumerate(words)}), words) == x


@settings(max_examples=20, deadline=None)
@given(some)
def test_codecs_round_trip(x):
    for name in codecs.CODECS:
        data, used, applied = codecs.encode_chunk(x, name, 3, ("x86", "lzp", "delta"))
        assert codecs.decode_chunk(data, used, applied) == x
        assert len(data) <= len(x) + 4


def test_damage_is_found(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, b"abc" * 500), (2, 0, bytes(1000))], "stream_id long, chunk_no long, data binary")
    coded = codecs.encoded(df, F.lit("zlib"))
    assert codecs.decoded(coded).where("error IS NOT NULL").count() == 0
    bad = coded.withColumn("data", F.concat(F.expr("substring(data, 1, 6)"), F.lit(b"\xff").cast("binary"), F.expr("substring(data, 8)")))
    assert codecs.decoded(bad).where("error IS NULL").count() == 0
    forged = bad.withColumn("crc", F.crc32("data"))
    assert codecs.decoded(forged).where("error IS NULL").count() == 0


def test_macs_need_the_key():
    for d in ("SHA256", "SHA512", "KECCAK256", "KECCAK512", "BLAKE256", "BLAKE512"):
        assert codecs.mac(b"x", b"k1", d) != codecs.mac(b"x", b"k2", d)


@pytest.mark.parametrize("bad", [dict(codec="zip"), dict(level=15), dict(block_bits=6), dict(similar="normal"), dict(digest="CRC64", dedupe="chunk"), dict(chunk_size=100), dict(pipe=True, archive=True), dict(key_bytes=7), dict(cipher="XOR"), dict(digest="MD5"), dict(dedupe="x"), dict(similar="x")])
def test_bad_options_raise(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_config():
    assert parse_size("8m") == 8 << 20 and parse_size("0x10") == 16 and parse_size("3K") == 3072
    for bad in ("8x", "", "9999999999g"):
        with pytest.raises(ValueError):
            parse_size(bad)
    assert Config.from_level("lz4").level == 1 and Config.from_level().level == 6
    high = Config.from_level("lzma", 14, archive=True)
    assert high.lzp and high.delta and high.media and high.exe and len(high.strides) == 7 and high.chunk_size == 20 << 20
    assert Config.from_level("lzma", 3).dedupe == "none"
    assert Config.from_level().resolve(1000).dedupe == "none" and Config.from_level().resolve(1 << 20).dedupe == "chunk"
    assert Config.from_args("-c zlib -l 9 -s 1m -B 3 -E").similar == "normal"
    assert Config(codec="none").series_span == 50
    assert segment_blocks(0) == 2048 and aligned_chunk(1, 0) == 4 << 20
    assert index_bytes(1 << 30, 2)["segmented"] < index_bytes(1 << 30, 2)["simple"]


def test_slices_give_the_blocks_of_the_whole(spark):
    x = np.random.default_rng(3).integers(0, 256, 150_000, np.uint8).tobytes()
    step = 40_000
    rows = [(1, a, len(x), x[max(0, a - 16) : a], x[a : a + step]) for a in range(0, len(x), step)]
    cut = chunking.slice_cuts(spark.createDataFrame(rows, "stream_id long, offset long, size long, before binary, data binary"), 0).orderBy("block_no").collect()
    whole = chunking.content_blocks(spark.createDataFrame([(1, x)], "stream_id long, data binary"), 0, whole=True).orderBy("block_no").collect()
    assert [(r["offset"], r["length"]) for r in cut] == [(r["offset"], r["length"]) for r in whole]


def test_container_versions(spark, tmp_path):
    from pyspark.sql import functions as F

    from blockloom.sources import streams

    df = spark.createDataFrame([(1, 0, b"abc" * 100)], "stream_id long, chunk_no long, data binary")
    coded = codecs.encoded(df, F.lit("zlib"))
    streams.write_container(coded, str(tmp_path / "a"))
    assert codecs.decoded(streams.read_container(spark, str(tmp_path / "a"))).first()["data"] == b"abc" * 100
    streams.write_container(coded.withColumn("version", F.lit(99)), str(tmp_path / "b"))
    with pytest.raises(Exception, match="unreadable version"):
        streams.read_container(spark, str(tmp_path / "b")).collect()


def test_files_source(spark, tmp_path):
    from blockloom.sources import streams

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_bytes(b"hello")
    assert streams.files(spark, str(tmp_path)).first()["data"] == b"hello"
    assert streams.files(spark, str(tmp_path), content=False).first()["size"] == 5


@pytest.mark.parametrize("name", ["lzma", "lzmaMt", "ppmd"])
def test_an_encoder_takes_no_more_memory_than_a_chunk_needs(name):
    import lzma

    data = bytes(range(256)) * 16
    made = codecs.CODECS[name].encode(data, 9)
    assert codecs.CODECS[name].decode(made, len(data)) == data == lzma.decompress(made, memlimit=1 << 20)  # the history alone took 64 MB
    for n in (0, 1, 4096, 4097, 1 << 17):
        assert codecs.CODECS[name].decode(codecs.CODECS[name].encode(bytes(n), 9), n) == bytes(n)


def test_filters_apply_to_what_stands_twice_before_a_series():
    from blockloom.plans import runs

    rng = np.random.default_rng(4)
    half = rng.bytes(100)
    inner = half + half  # a shorter repeat is nearer than the longer one, which hid it
    line = b"Et tre\xc3\xaaaux treleai pouren\xc3\xaaaire aire de au leaneau."
    far = b"".join(line[k : k + 14] + bytes([k, 200 - k]) for k in range(13))
    for data in (inner, far, (line + line[:40]) * 3, rng.bytes(200), rng.bytes(3_000_000)):
        whole = runs.repeated(data)
        for name in ("lzp", "delta"):
            made = codecs.FILTERS[name][0](whole)
            assert made is not None and len(made) < len(whole) and codecs.FILTERS[name][1](made) == whole


def test_repeats_are_found_past_nearer_shorter_ones():
    rng = np.random.default_rng(5)
    words = [rng.bytes(6) for _ in range(3)]
    unit = b"".join(words[k] for k in rng.integers(0, 3, 22))  # every twelve bytes stand in many places
    made = codecs.lzp_encode(unit + unit)
    assert made is not None and codecs.lzp_decode(made) == unit + unit


@settings(max_examples=60, deadline=None)
@given(some, st.integers(16, 200))
def test_repeats_of_any_least_length(x, least):
    made = codecs.lzp_encode(x + x, least)
    assert made is None or codecs.lzp_decode(made) == x + x
    if len(x) >= least + 16:
        assert made is not None


def test_sketches_of_many_blocks_stay_apart():
    from blockloom.operators import similarity

    keys = np.random.default_rng(6).integers(0, 1 << 63, 300_000).tolist()
    assert len({similarity.sketch(k.to_bytes(8, "little"), 7, 0) for k in keys}) == len(keys)
    assert {type(s) for s in map(similarity.signed, (b"", b"a", b"b"))} == {int} and all(-(1 << 63) <= similarity.signed(bytes([k])) < 1 << 63 for k in range(256))


def test_patch_of_a_block_with_few_words():
    from blockloom.plans import runs

    rng = np.random.default_rng(7)
    words = [rng.bytes(8) for _ in range(3)]
    old = b"".join(words[k] for k in rng.integers(0, 3, 256))
    new = runs.raised(rng.bytes(8) + old[8:])
    made = delta.diff(old, new)
    assert delta.patch(old, made) == new and len(made) < 100
