"""Digests, containers, configurations, references that are similar, and state that is forgotten."""

import hashlib
import lzma
import random

import pytest
from pyspark.sql import functions as F

from blockloom.config import Config
from blockloom.operators import chunking, codecs, dedupe, delta, digests, rebuild, secrecy, similarity
from blockloom.plans import runs
from blockloom.sources import containers
from blockloom.streaming import dedupe as streaming


def xz_crc64(data):
    """The checksum that the xz format keeps of its content."""
    made = lzma.compress(data, format=lzma.FORMAT_XZ, check=lzma.CHECK_CRC64, preset=0)
    at = len(made) - 12 - (int.from_bytes(made[-8:-4], "little") + 1) * 4
    return int.from_bytes(made[at - 8 : at], "little") if data else 0


def test_crc64():
    assert digests.crc64(b"123456789") == 0x995DC9BBDF1939FA
    rng = random.Random(1)
    for n in (0, 1, 8, 300, 2047, 2048, 2049, 10_001, 262_144):
        data = rng.randbytes(n)
        assert digests.crc64(data) == xz_crc64(data)
    assert codecs.DIGESTS["CRC64"][1](b"123456789").hex() == "995dc9bbdf1939fa"


def test_known_digests():
    for name, want in (
        ("SHA256", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("KECCAK256", "3a985da74fe225b2045c172d6bd390bd855f086e3e9d525b46bfe24511431532"),
        ("BLAKE512", hashlib.blake2b(b"abc").hexdigest()),
    ):
        assert codecs.DIGESTS[name][1](b"abc").hex() == want


def test_digest_expressions(spark):
    df = spark.createDataFrame([(1, b"abc"), (2, b"")], "stream_id long, data binary")
    row = df.where("stream_id = 1").select(*(digests.digest(F.col("data"), n).alias(n) for n in digests.EXPRESSIONS)).first()
    assert row["SHA512"] == hashlib.sha512(b"abc").hexdigest() and row["MD5"] == hashlib.md5(b"abc").hexdigest() and row["CRC32"] == "352441c2" and len(row["XXH64"]) == 16
    with pytest.raises(ValueError):
        digests.digest(F.col("data"), "SKEIN256")
    for key in (b"k", b"x" * 200):
        for name in ("SHA256", "SHA512", "BLAKE256"):
            got = {r["stream_id"]: r["mac"] for r in codecs.keyed_macs(df, key[:64] if name == "BLAKE256" else key, name).collect()}
            assert got == {1: codecs.mac(b"abc", key[:64] if name == "BLAKE256" else key, name).hex(), 2: codecs.mac(b"", key[:64] if name == "BLAKE256" else key, name).hex()}


def test_similar_references_are_rebuilt(spark):
    rng = random.Random(2)
    a = rng.randbytes(4096)
    changed = runs.raised(a)
    rows = [(1, a), (2, changed), (3, changed + b"tail"), (4, a[:2048]), (5, b""), (6, b"x")]
    df = spark.createDataFrame(rows, "stream_id long, data binary")
    cut = chunking.fixed_blocks(df, 2048, keep_data=True)
    pairs = similarity.similar_blocks(similarity.with_sketch(cut, 2048, least=64))
    store = rebuild.stored_similar(dedupe.references(cut.drop("data")), cut, pairs)
    kinds = {(r["stream_id"], r["block_no"]): r["kind"] for r in store.collect()}
    assert kinds[2, 0] == "similar" and kinds[3, 0] == "exact" and kinds[4, 0] == "exact" and kinds[1, 0] == "literal"
    assert store.where("kind = 'similar'").first()["data"] == delta.diff(a[:2048], changed[:2048])
    assert all(r["equal"] for r in rebuild.verified(df, rebuild.rebuilt(store)).collect())
    assert {r["stream_id"]: bytes(r["data"]) for r in rebuild.rebuilt(store).collect()} == {k: v for k, v in rows if v}


def test_only_blocks_apart_are_similar(spark):
    rng = random.Random(3)
    a = rng.randbytes(2048)
    rows = [(1, a + runs.raised(a) + rng.randbytes(4096) + runs.raised(a[:1024] + rng.randbytes(8) + a[1032:]))]
    df = spark.createDataFrame(rows, "stream_id long, data binary")
    sketched = similarity.with_sketch(chunking.fixed_blocks(df, 2048, keep_data=True), 2048, least=64)
    assert [r["block_no"] for r in similarity.similar_blocks(sketched).collect()] == [1]
    assert similarity.similar_blocks(sketched, 2048).count() == 0


def test_container(spark, tmp_path):
    config = Config.from_level("zlib", 6, chunk_size=4096)
    members = spark.createDataFrame([(k, bytes([k]) * 9000, "text", "") for k in range(5)], "stream_id long, data binary, primary string, subtype string")
    containers.write(runs.encoded_by(config, members), str(tmp_path / "c"), config, members.select("stream_id", "primary"))
    header, chunks, table = containers.read(spark, str(tmp_path / "c"))
    assert header["codec"] == "zlib" and header["chunk_size"] == 4096 and table.count() == 5
    back = codecs.decoded(chunks).collect()
    assert len(back) == 15 and all(r["error"] is None for r in back)
    files = [[(r["stream_id"], r["chunk_no"]) for r in spark.read.parquet(str(f)).collect()] for f in sorted((tmp_path / "c/chunks").glob("part-*"))]
    assert [x for f in files for x in f] == sorted(x for f in files for x in f)
    spark.createDataFrame([(99, "zlib", 6, 4096, "none", "SHA256", False)], "version int, codec string, level int, chunk_size long, dedupe string, digest string, members boolean").write.mode("overwrite").parquet(str(tmp_path / "c/header"))
    with pytest.raises(ValueError, match="version 99"):
        containers.read(spark, str(tmp_path / "c"))
    assert containers.timed(10 << 20, lambda: 7, iter([1.0, 3.0]).__next__) == (7, 5.0)


def test_configurations_run(spark):
    texts = [("text " * 3000).encode(), bytes(range(256)) * 40, (b"abcdefgh" * 2 + b"\0" * 9) * 500]
    rows = [(k, d, p, s) for k, (d, p, s) in enumerate(zip(texts, ("text", "binary", "compressed"), ("", "", "jpeg")))]
    members = spark.createDataFrame(rows, "stream_id long, data binary, primary string, subtype string")
    for codec, want in (("adapt", {0: "ppmd", 1: "bzip2"}), ("adapt2", {0: "libbsc", 1: "lzma"}), ("zlib", {0: "zlib", 1: "zlib"})):
        made = runs.encoded_by(Config.from_level(codec, 10, chunk_size=8192), members)
        got = {r["stream_id"]: r["codec_requested"] for r in made.collect()}
        assert {k: got[k] for k in want} == want
        assert any(r["filters"] for r in made.collect())  # lzp and series are on from these levels
        assert all(r["error"] is None for r in codecs.decoded(made).collect())
    low = runs.encoded_by(Config.from_level("zlib", 6, chunk_size=8192), members).where("stream_id = 2").first()
    assert low["codec_requested"] == "none" and low["codec_used"] == "raw"


def test_series_spans_count():
    data = b"".join(bytes([k]) for k in range(40)) * 1 + (b"x" * 7 + b"\0") * 3
    series = b"".join((5 + 3 * k).to_bytes(8, "little") for k in range(15))  # 120 bytes
    assert codecs.encode_chunk(data + series, "none", 6, ("delta",), 50)[2] == ["delta"] or codecs.encode_chunk(series, "none", 6, ("delta",), 50)[2] == ["delta"]
    assert codecs.encode_chunk(series, "none", 6, ("delta",), 200)[2] == []


def test_config_file(tmp_path):
    config = Config.from_level("adapt2", 11, chunk_size=65536)
    config.to_file(tmp_path / "c")
    assert Config.from_file(tmp_path / "c") == config
    (tmp_path / "d").write_text("# a store\ncodec=zlib\nchunk_size=8m\nlzp=true\n\n")
    assert Config.from_file(tmp_path / "d") == Config(codec="zlib", chunk_size=8 << 20, lzp=True)
    (tmp_path / "d").write_text("unknown=1\n")
    with pytest.raises(ValueError):
        Config.from_file(tmp_path / "d")


def test_passwords(tmp_path, monkeypatch):
    monkeypatch.setenv("BLOCKLOOM_PASSWORD", "one")
    assert secrecy.password() == "one"
    (tmp_path / "p").write_text("two\n")
    assert secrecy.password(path=str(tmp_path / "p")) == "two" and (tmp_path / "p").read_bytes() == b"\0" * 4
    with pytest.raises(ValueError):
        secrecy.password("NO_SUCH_VARIABLE")


def test_lzp_repeats_may_reach_into_themselves():
    for unit in (b"a", b"abc", bytes(range(200))):
        data = b"head" + unit * (2000 // len(unit)) + b"tail"
        made = codecs.lzp_encode(data)
        assert made is not None and codecs.lzp_decode(made) == data


class Held:
    """A state as the engine hands it out."""

    def __init__(self):
        self.value, self.exists, self.hasTimedOut, self.timeout = None, False, False, None

    get = property(lambda self: self.value)

    def update(self, value):
        self.value, self.exists = value, True

    def remove(self):
        self.value, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_state_is_forgotten():
    import pandas as pd

    rows = pd.DataFrame({"stream_id": [3, 2], "block_no": [0, 1], "length": [9, 9], "cksum": ["c", "c"]})
    state = Held()
    kinds = lambda: [k for f in streaming.first_or_reference(("c", 9), iter([rows]), state, 1000) for k in f.kind]
    assert kinds() == ["literal", "exact"] and state.get == (2, 1) and state.timeout == 1000
    assert kinds() == ["exact", "exact"]
    state.hasTimedOut = True
    assert kinds() == [] and not state.exists
    state.hasTimedOut = False
    assert kinds() == ["literal", "exact"]


def test_groups_of_a_part_over_many_ranges(spark):
    import itertools
    import random

    from blockloom.operators import archive

    rng, rows = random.Random(3), []
    for part, n in (("hot", 900), ("b", 40), (None, 30), ("one", 1)):
        t = "x"
        for no in range(n):
            t = rng.choice(["x", "y", None]) if rng.random() < 0.1 else t
            rows.append((part, no, t, rng.randrange(50)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "part string, no long, kind string, size long").repartition(7)
    want, cut = [], []
    for part in ("hot", "b", None, "one"):
        mine = sorted((r for r in rows if r[0] == part), key=lambda r: r[1])
        for i, (k, g) in enumerate(itertools.groupby(mine, key=lambda r: r[2])):
            g = list(g)
            want.append((part, i + 1, k, len(g), sum(r[3] for r in g)))
        mine_cut = []
        for _, _, k, size in mine:
            if not mine_cut or mine_cut[-1][2] != k and mine_cut[-1][4] >= 300:
                mine_cut.append([part, len(mine_cut) + 1, k, 0, 0])
            mine_cut[-1][3] += 1
            mine_cut[-1][4] += size
        cut += map(tuple, mine_cut)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges stay apart
    try:
        assert set(map(tuple, archive.type_groups(df, "part", ["no"], "kind").collect())) == set(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    got = archive.type_groups(df, "part", ["no"], "kind").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == set(want)
    got = archive.type_cuts(df, "part", "no", "kind", 300).collect()
    assert len(got) == len(cut) and set(map(tuple, got)) == set(cut)
    empty = df.limit(0)
    assert archive.type_groups(empty, "part", ["no"], "kind").count() == archive.type_cuts(empty, "part", "no", "kind", 300).count() == 0


def test_archives_of_both_formats(spark):
    import io
    import zipfile

    from blockloom.operators import archive

    rows = [(f"a/{i}", bytes([i]) * (i * 9)) for i in range(40)] + [("/etc/x", b"out"), ("../x", b"out")]
    df = spark.createDataFrame(rows, "path string, data binary")
    assert archive.archive_count(df, 1000) > 40 and archive.archive_count(df) == archive.archive_count(df.limit(0)) == 1
    for pack in (archive.tar_archives, archive.zip_archives):
        for n in (1, 7):
            got = sorted((r["path"], bytes(r["data"])) for r in archive.archive_members(pack(df, n)).collect())
            assert got == sorted(r for r in rows if r[0][0] == "a")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "a/1")
        z.writestr("dir/", "")
        z.writestr("f", "body")
    assert list(archive.opened(out.getvalue())) == [("f", b"body")]


def test_lines_as_words(spark):
    from blockloom.operators import dictionary

    text = ">seq 1\nACGT12345ACGT\n\nacgt\nACGT12345ACGT\nTail"
    df = spark.createDataFrame([(1, text)], "stream_id long, text string")
    got = {r["word"]: r["n"] for r in dictionary.word_frequency(df, separators=dictionary.LINES).collect()}
    assert got == {">seq 1": 1, "ACGT12345ACGT": 2, "acgt": 1, "Tail": 1}
    words = ["ACGT12345ACGT", "tail"]
    code = dictionary.encode(text.encode(), {w.encode(): i for i, w in enumerate(words)}, lines=True)
    assert dictionary.decode(code, [w.encode() for w in words]).decode() == text
    assert code.count(dictionary.WORD) == 2 and dictionary.DIGITS not in code and dictionary.UPPER not in code
    row = dictionary.encoded(df.select("stream_id", df.text.cast("binary").alias("data")), words, lines=True).first()
    assert row["restored"] and row["encoded_bytes"] < row["raw_bytes"]


def test_filters_by_type(spark):
    from blockloom.operators import codecs

    text, twice = b"plain text, nothing more", b"head" + b"abcdefgh" * 500
    series = b"".join((5 + 3 * k).to_bytes(8, "little") for k in range(400))
    rows = [(1, "wav", series), (2, "txt", series), (3, None, series), (4, "tar", twice), (5, "wav", None), (6, "wav", b""), (7, "exe32", text)]
    made = codecs.filtered(spark.createDataFrame(rows, "stream_id long, subtype string, data binary"))
    got = {r["stream_id"]: (r["filter_name"], r["data"]) for r in made.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "delta", 2: None, 3: None, 4: "lzp", 5: None, 6: None, 7: None}
    assert len(got[1][1]) < len(series) and len(got[4][1]) < len(twice)
    back = {r["stream_id"]: r["data"] for r in codecs.unfiltered(made).collect()}
    assert {k: v if v is None else bytes(v) for k, v in back.items()} == {k: d for k, _, d in rows}


def test_detail_of_references(spark):
    from blockloom.operators import dedupe

    rows = [(1, 0, 0, 8, "literal"), (1, 1, 8, 8, "literal"), (1, 2, 16, 8, "exact"), (1, 3, 24, 3, "literal"), (2, 0, 0, 8, "exact")]
    refs = spark.createDataFrame(rows, "stream_id long, block_no long, offset long, length long, kind string")
    assert tuple(dedupe.detail(refs, 8).first()) == (4, 3, 1)
    assert tuple(dedupe.detail(refs.limit(0), 8).first()) == (0, 0, 0)


def test_variants_are_saved_whatever_other_blocks_there_are(spark):
    blocks = [hashlib.shake_128(k.to_bytes(4, "little")).digest(2048) for k in (4378, 8508)]  # their sketches of 32 bits were the same
    rows = [(2 * k, b) for k, b in enumerate(blocks)] + [(2 * k + 1, runs.raised(b)) for k, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "stream_id long, data binary")
    cut = chunking.fixed_blocks(df, 2048, keep_data=True)
    pairs = similarity.similar_blocks(similarity.with_sketch(cut, 2048, least=64))
    store = rebuild.stored_similar(dedupe.references(cut.drop("data")), cut, pairs)
    kinds = {r["stream_id"]: (r["kind"], r["ref_stream"]) for r in store.collect()}
    assert kinds == {0: ("literal", 0), 1: ("similar", 0), 2: ("literal", 2), 3: ("similar", 2)}
    assert all(r["equal"] for r in rebuild.verified(df, rebuild.rebuilt(store)).collect())


def test_codecs_of_one_chunk_share_what_is_the_same(spark, monkeypatch):
    rows = [(1, 0, b"abc" * 500), (1, 1, b"x"), (2, 0, bytes(range(256)) * 9), (3, 0, b"")]
    df = spark.createDataFrame(rows, "stream_id long, chunk_no long, data binary")
    names = list(codecs.CODECS)
    one = codecs.encoded(df.withColumn("c", F.explode(F.array(*map(F.lit, names)))), F.col("c"), 3, ("lzp", "delta"), spans={"bzip2": 200})
    many = codecs.encoded(df, F.array(*map(F.lit, names)), 3, ("lzp", "delta"), spans={"bzip2": 200})
    assert one.schema == many.schema and sorted(map(str, one.collect())) == sorted(map(str, many.collect())) and many.count() == len(rows) * len(names)
    back = codecs.decoded(many).collect()
    want = {(s, c): d for s, c, d in rows}
    assert all(r["error"] is None and bytes(r["data"]) == want[r["stream_id"], r["chunk_no"]] for r in back) and len(back) == len(rows) * len(names)
    wrong = codecs.decoded(many.withColumn("digest", F.when(F.col("codec_requested") == "ppmd", "0").otherwise(F.col("digest"))))
    assert {(r["error"], r["n"]) for r in wrong.groupBy("error").agg(F.count("*").alias("n")).collect()} == {("digest", len(rows)), (None, len(rows) * (len(names) - 1))}


@pytest.fixture
def no_bound(spark):
    """The session without a bound on the bytes of Arrow batches, as a new one is."""
    from blockloom.shared import BATCH_SETTING

    was = spark.conf.get(BATCH_SETTING, None)
    spark.conf.unset(BATCH_SETTING)
    yield lambda: spark.conf.get(BATCH_SETTING, None)
    spark.conf.unset(BATCH_SETTING) if was is None else spark.conf.set(BATCH_SETTING, was)


def test_batches_of_kernels_are_bounded_in_bytes(spark, no_bound):
    import pyarrow as pa

    from blockloom.shared import BATCH_BYTES, mapped

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([batch.nbytes], pa.int64())], names=["n", "size"])

    rows = spark.range(0, 60, 1, 1).select(F.encode(F.repeat(F.lit("x"), 1 << 19), "UTF-8").alias("data"))
    got = mapped(rows, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 60 and max(r["size"] for r in got) < 2 * BATCH_BYTES


def test_filters_and_codecs_bound_their_batches(spark, no_bound):
    df = spark.createDataFrame([(1, "wav", b"x" * 100)], "stream_id long, subtype string, data binary")
    assert no_bound() is None
    assert codecs.unfiltered(codecs.filtered(df)).count() == 1 and no_bound() is not None


def test_sketches_bound_their_batches(spark, no_bound):
    rows = spark.createDataFrame([(1, b"abcdefgh" * 300)], "stream_id long, data binary")
    assert no_bound() is None
    planted = runs.with_variants(rows)
    assert no_bound() is not None
    assert similarity.similar_blocks(similarity.with_sketch(chunking.fixed_blocks(planted, 2048, keep_data=True), 2048, least=64)).count() >= 1


def test_damaged_chunks_are_found_in_bounded_batches(spark, no_bound):
    chunks = spark.createDataFrame([(k, 0, bytes([k]) * 900) for k in range(4)], "stream_id long, chunk_no long, data binary")
    assert no_bound() is None
    made = codecs.encoded(chunks, F.lit("zlib"))
    assert no_bound() is not None
    hurt = made.withColumn("data", F.when(F.col("stream_id") == 2, F.concat(F.lit(b"\0").cast("binary"), "data")).otherwise(F.col("data")))
    assert {r["stream_id"]: r["error"] for r in codecs.decoded(hurt).collect()} == {0: None, 1: None, 2: "crc", 3: None}


def test_a_stream_refers_to_what_arrived_before(spark, tmp_path):
    from blockloom.sources import streams

    schema = "stream_id long, block_no long, length long, cksum string"
    arrivals = [[(5, 0, 9, "a"), (4, 1, 9, "a"), (4, 0, 9, "b"), (6, 0, 8, "a")], [(1, 0, 9, "a"), (2, 1, 9, "c"), (2, 0, 9, "c"), (2, 0, 9, "c")], [(0, 0, 9, "c"), (0, 1, 9, "d")]]
    places = [f"{tmp_path}/{x}" for x in ("out", "index", "state")]
    seen, want = {}, []
    for rows in arrivals:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        got = streaming.references_to_table(spark, streams.stream_of(spark, f"{tmp_path}/in", schema), *places)
        before = dict(seen)
        for s, b, n, c in sorted(rows):
            seen.setdefault((c, n), (s, b))
        want += [(s, b, n, c, "literal" if (c, n) not in before and seen[c, n] == (s, b) else "exact", *seen[c, n]) for s, b, n, c in rows]
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.columns == ["stream_id", "block_no", "length", "cksum", "kind", "ref_stream", "ref_block"]
    again = streaming.references_to_table(spark, streams.stream_of(spark, f"{tmp_path}/in", schema), *places)  # nothing new
    assert again.count() == len(want)


def test_equal_bytes_are_judged_row_by_row(spark):
    made = codecs.encoded(spark.createDataFrame([(1, 0, b"abcd" * 300)], "stream_id long, chunk_no long, data binary"), F.array(*map(F.lit, ("lzma", "ppmd", "lzmaMt"))))
    hurt = made.withColumn("data", F.when(F.col("codec_requested") == "ppmd", F.concat("data", F.lit(b"\0").cast("binary"))).otherwise(F.col("data")))
    late = made.withColumn("digest", F.when(F.col("codec_requested") == "lzmaMt", "no").otherwise(F.col("digest")))
    named = lambda df: {r["stream_id"]: (r["error"], r["data"] and bytes(r["data"])) for r in codecs.decoded(df.withColumn("stream_id", F.col("codec_requested"))).collect()}
    whole = (None, b"abcd" * 300)
    assert named(made) == {"lzma": whole, "ppmd": whole, "lzmaMt": whole}
    assert named(hurt) == {"lzma": whole, "ppmd": ("crc", None), "lzmaMt": whole}
    assert named(late) == {"lzma": whole, "ppmd": whole, "lzmaMt": ("digest", None)}


def test_a_quick_look_for_series_misses_none():
    import random

    import numpy as np

    from blockloom.operators import delta

    rng = random.Random(3)
    for case in range(600):
        made = [rng.randbytes(rng.randint(0, 90)), (np.arange(rng.choice([5, 6, 7, 12, 13, 25, 26, 600]), dtype="<u8") * rng.randint(0, 1 << 60)).astype(rng.choice(["<u2", "<u4", "<u8"])).tobytes(), rng.randbytes(rng.randint(0, 5000))]
        data = b"".join(made if case % 2 else made[::2])
        for stride in (2, 4, 8):
            for least in (20, 50, 200):
                if any(delta.series(data[a : a + delta.SERIES_BLOCK], stride, least) for a in range(0, len(data), delta.SERIES_BLOCK)):
                    assert delta.may_have_series(data, stride, least)
        if (coded := delta.series_encode(data)) is not None:
            assert delta.series_decode(coded) == data


def test_texts_without_series_are_not_searched_block_by_block(monkeypatch):
    from blockloom.operators import delta

    text = " ".join(f"word{k * k % 7919}" for k in range(9000)).encode()
    calls = []
    monkeypatch.setattr(delta, "series", lambda *a: calls.append(a) or [])
    assert delta.series_encode(text) is None and not calls


def test_lengths_take_the_place_of_decoded_bytes(spark):
    rows = [(1, 0, b"abcd" * 300), (2, 0, b"z" * 70_000), (2, 1, b"q")]
    made = codecs.encoded(spark.createDataFrame(rows, "stream_id long, chunk_no long, data binary"), F.array(*map(F.lit, ("zlib", "ppmd"))), 3, ("lzp",))
    hurt = made.withColumn("digest", F.when(F.col("stream_id") == 1, "no").otherwise(F.col("digest")))
    back = codecs.decoded(hurt, keep_data=False)
    assert back.columns == ["stream_id", "chunk_no", "length", "error"]
    assert sorted(map(tuple, back.collect()), key=str) == sorted([(s, c, None if s == 1 else len(d), "digest" if s == 1 else None) for s, c, d in rows for _ in range(2)], key=str)


def test_decoded_bytes_leave_the_kernel_in_bounded_batches(spark, monkeypatch):
    from blockloom.shared import BATCH_BYTES

    rows = [(k, 0, bytes([k]) * (1 << 20)) for k in range(24)]  # 24 MB that take some KB when encoded
    made = codecs.encoded(spark.createDataFrame(rows, "stream_id long, chunk_no long, data binary").coalesce(1), F.lit("zlib"))
    made = made.withColumn("data", F.when(F.col("stream_id") == 5, F.concat(F.lit(b"\0").cast("binary"), "data")).otherwise(F.col("data"))).persist()
    caught = []
    monkeypatch.setattr(codecs, "mapped", lambda df, run, schema: caught.append((df, run)) or df)
    codecs.decoded(made)
    (df, run), = caught
    table = df.toArrow().combine_chunks()
    assert table.nbytes < BATCH_BYTES
    out = list(run(iter(table.to_batches())))
    assert max(b.nbytes for b in out) <= 2 * BATCH_BYTES
    got = [x for b in out for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got) == sorted((k, 0, None if k == 5 else d, "crc" if k == 5 else None) for k, _, d in rows)
    made.unpersist()
