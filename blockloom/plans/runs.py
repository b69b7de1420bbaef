"""Runs of whole configurations, and queries over inputs that are made so that an operator has something to do."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.config import SERIES_SPAN, Config
from blockloom.functions import content
from blockloom.operators import chunking, codecs, dedupe, rebuild, similarity
from blockloom.plans import catalogue as c
from blockloom.shared import mapped
from blockloom.sources import streams

# content-defined blocks in SQL: the cut candidates of a stream, and the choice among them step by step

LEAST, MOST = chunking.limits(0, False)
SQL_CUTS = c.CANDIDATES.partition("SELECT doc_id, count(*)")[0].replace("WITH d AS", "WITH RECURSIVE d AS").rstrip() + f""",
l AS (SELECT doc_id, list(i ORDER BY i) FILTER (xor(s % 1024, (1 + gone * {int(chunking.LEAVING[1] - 1)}) % 1024) = 0) AS l FROM w WHERE gone IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, strlen(text) AS n, hex(encode(text)) AS h, coalesce(l, []) AS l FROM documents LEFT JOIN l USING (doc_id) WHERE strlen(text) > 0),
r(doc_id, last, stop) AS (SELECT doc_id, 0, 0 FROM t UNION ALL
  SELECT doc_id, CASE WHEN go THEN e + 1 ELSE n END, CASE WHEN go THEN 0 ELSE 1 END FROM (SELECT *, n - last > {LEAST} AND e < n - {chunking.WINDOW} AS go FROM (
    SELECT t.doc_id, n, last, least(coalesce([x for x in l if x >= last + {LEAST - 1}][1], n), last + {MOST - 1}) AS e FROM r JOIN t ON t.doc_id = r.doc_id WHERE stop = 0 AND last < n))),
b AS (SELECT t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY last) - 1 AS block_no, start AS "offset", last - start AS length, sha256(unhex(substr(h, 1 + 2 * CAST(start AS BIGINT), 2 * CAST(last - start AS BIGINT)))) AS cksum
  FROM (SELECT doc_id, last, lag(last) OVER (PARTITION BY doc_id ORDER BY last) AS start FROM r) x JOIN t ON t.doc_id = x.doc_id WHERE start IS NOT NULL)"""
c.ORACLES["cdc_blocks"] = f'{SQL_CUTS} SELECT doc_id, block_no, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, cksum FROM b'
c.ORACLES["cdc_dedupe_summary"] = f"{SQL_CUTS} {c.SUMMARY}"


@c.query(c.CANDIDATES.partition("SELECT doc_id, count(*)")[0] + f"""SELECT doc_id, CAST(coalesce(max(i) FILTER (xor(s % 1024, (1 + gone * {int(chunking.LEAVING[1] - 1)}) % 1024) = 0 AND i >= n - 4096), -1) AS BIGINT) AS last_cut
FROM w JOIN (SELECT doc_id, strlen(text) AS n FROM documents) USING (doc_id) WHERE gone IS NOT NULL GROUP BY doc_id""")
def last_cut(spark, sf_dir):
    return c.as_doc(chunking.last_cuts(streams.documents(spark, sf_dir).where(F.octet_length("data") > 16), 4096))


@c.query(f"WITH {c.sql_blocks(c.SMALL)} {c.SUMMARY}")
def fast_hash_dedupe(spark, sf_dir):
    """Deduplication by a fast 64-bit digest."""
    return dedupe.summary(chunking.fixed_blocks(streams.documents(spark, sf_dir), c.SMALL, digest="XXH64"))


@c.query(f"WITH {c.sql_blocks(c.BLOCK).replace('sha256(unhex', 'md5(unhex')} SELECT doc_id, block_no, cksum FROM b")
def block_digests(spark, sf_dir):
    """Blocks with another digest than the default."""
    return c.as_doc(chunking.fixed_blocks(streams.documents(spark, sf_dir), c.BLOCK, digest="MD5").select("stream_id", "block_no", "cksum"))


# configurations

def encoded_by(config: Config, members: DataFrame) -> DataFrame:
    """members (stream_id, data, primary, subtype) encoded as config says.

    Chunks are cut by its size (the default's if it has none); adapt and adapt2 choose each member's codec; compressed
    members that a codec refuses at this level stay raw; series must exceed the codec's span.
    """
    size = config.chunk_size or Config.from_level(config.codec, config.level).chunk_size
    chosen = content.adaptive_codec(config.codec, F.col("primary"), F.col("subtype")) if config.codec.startswith("adapt") else F.lit(config.codec)
    skips = content.codec_skips(config.codec, F.lit(config.level), F.col("primary"), F.col("subtype"))
    rows = chunking.chunks(members, size, ("primary", "subtype")).withColumn("codec", F.when(skips, "none").otherwise(chosen))
    filters = tuple(f for f, on in (("x86", config.exe), ("lzp", config.lzp), ("delta", config.delta)) if on)
    spans = {k: max(config.series_span, v) if config.codec.startswith("adapt") else config.series_span for k, v in SERIES_SPAN.items()}
    return codecs.encoded(rows, F.col("codec"), config.level, filters, config.digest, spans, config.strides)


CHUNK = 4096
RUNS = (("lz4", 1), ("zlib", 6), ("lzma", 5), ("bzip2", 10), ("adapt", 10), ("adapt2", 10))
VERDICTS = {"adapt": "fifty", "adapt2": "thirty"}


@c.query(f"WITH {c.SQL_KINDS}, n AS (SELECT 'd' || doc_id AS id, (strlen(text) + {CHUNK - 1}) // {CHUNK} AS n FROM documents WHERE strlen(text) > 0), " + "r AS (" + " UNION ALL ".join(
    f"SELECT '{codec} {level}' AS run, n, {codec if codec in VERDICTS else repr(codec)} AS codec_requested FROM n JOIN c USING (id)" for codec, level in RUNS
) + ") SELECT run, codec_requested, CAST(sum(n) AS BIGINT) AS n_chunks, 0 AS errors FROM r GROUP BY ALL")
def level_round_trip(spark, sf_dir):
    """Documents encoded as configurations say, and decoded again: chunks by run and codec, and what did not come back."""
    kinds, out = c.kinds(spark, sf_dir), None
    docs = streams.documents(spark, sf_dir).withColumn("stream_id", F.concat(F.lit("d"), F.col("stream_id").cast("string")))
    for codec, level in RUNS:
        config = Config.from_level(codec, level, chunk_size=CHUNK)
        members = docs.join(kinds.select(F.col("id").alias("stream_id"), F.col(VERDICTS.get(codec, "fifty")).alias("primary"), "subtype"), "stream_id")
        made = encoded_by(config, members)
        back = codecs.decoded(made.withColumn("stream_id", F.concat_ws(" ", "codec_requested", "stream_id")), config.digest, keep_data=False)
        rows = back.groupBy(F.lit(f"{codec} {level}").alias("run"), F.substring_index("stream_id", " ", 1).alias("codec_requested")).agg(F.count("*").alias("n_chunks"), F.count_if(F.col("error").isNotNull()).cast("int").alias("errors"))
        out = rows if out is None else out.unionByName(rows)
    return out


# planted inputs

def kernel(streams_: DataFrame, step) -> DataFrame:
    """streams with data changed by step, bytes to bytes."""
    kind = streams_.schema["stream_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([step(d.as_py()) for d in batch.column(1)], pa.binary())], names=["stream_id", "data"])

    return streams_.select("stream_id", "data").transform(mapped, run, f"stream_id {kind}, data binary")


def raised(data: bytes) -> bytes:
    """data with the largest 8-byte word of its first block made larger, which a sketch of the smallest words leaves out."""
    words = np.frombuffer(data[: c.BLOCK], "<i8", min(len(data), c.BLOCK) // 8).copy()
    if len(words):
        words[words.argmax()] = 2**63 - 1
    return words.tobytes() + data[8 * len(words) :]


def with_variants(docs: DataFrame) -> DataFrame:
    """Streams 2k of the documents and 2k + 1 of a variant of each, similar in its first block."""
    return docs.withColumn("stream_id", 2 * F.col("stream_id")).unionByName(kernel(docs, raised).withColumn("stream_id", 2 * F.col("stream_id") + 1))


@c.query(f"""SELECT doc_id, v AS variant, true AS equal, v = 1 AND strlen(text) >= {c.BLOCK} AS saved FROM documents, (VALUES (0), (1)) AS x(v)""")
def similar_rebuild_verify(spark, sf_dir):
    """Streams and variants of them stored with exact and similar references, and rebuilt; saved: a full first block of a
    variant is kept as a reference."""
    all_ = with_variants(streams.documents(spark, sf_dir))
    cut = chunking.fixed_blocks(all_, c.BLOCK, keep_data=True)
    pairs = similarity.similar_blocks(similarity.with_sketch(cut, c.BLOCK, least=64))
    store = rebuild.stored_similar(dedupe.references(cut.drop("data")), cut, pairs)
    equal = rebuild.verified(all_, rebuild.rebuilt(store))
    saved = store.where(f"block_no = 0 AND length = {c.BLOCK} AND kind <> 'literal' AND stream_id % 2 = 1").select("stream_id", F.lit(True).alias("saved"))
    out = equal.join(saved, "stream_id", "left")
    return out.select(F.expr("stream_id div 2").alias("doc_id"), F.expr("CAST(stream_id % 2 AS INT)").alias("variant"), "equal", F.coalesce("saved", F.lit(False)).alias("saved"))


@c.query(f"SELECT 2 * doc_id + 1 AS doc_id, CAST(0 AS BIGINT) AS block_no FROM documents WHERE strlen(text) >= {c.BLOCK}")
def similar_blocks_planted(spark, sf_dir):
    """First blocks of variants, each with an earlier block that is similar."""
    cut = chunking.fixed_blocks(with_variants(streams.documents(spark, sf_dir)), c.BLOCK, keep_data=True).where(f"block_no = 0 AND length = {c.BLOCK}")
    return c.as_doc(similarity.similar_blocks(similarity.with_sketch(cut, c.BLOCK, least=64)).where("stream_id % 2 = 1").select("stream_id", "block_no"))


CODE = bytes.fromhex("8B0000E81020300000")


def coded(key: Column) -> Column:
    """Bytes like those of machine code, more of them for some keys."""
    return F.unhex(F.repeat(F.lit(CODE.hex()), F.pmod(key, F.lit(12)).cast("int") * 8))


SQL_CODED = f"""d AS (SELECT doc_id, repeat('{CODE.hex().upper()}', CAST(doc_id % 12 AS INT) * 8) || hex(encode(text)) AS h FROM documents),
x AS (SELECT doc_id, substr(h, 1 + 2 * i, 2) AS b FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (b = '8B') AS m, count(*) FILTER (b = '00') AS z, count(*) FILTER (b = 'E8') AS e FROM x GROUP BY doc_id),
a AS (SELECT doc_id, coalesce(m > n / 256 AND z > 2 * n / 256 AND e > 6, false) AS applied FROM d LEFT JOIN n USING (doc_id))"""


@c.query(f"WITH {SQL_CODED} SELECT doc_id, applied, true AS restored FROM a")
def x86_planted(spark, sf_dir):
    """The call filter over documents after bytes like those of machine code: where it applied, and that it can be undone."""
    rows = streams.documents(spark, sf_dir).withColumn("data", F.concat(coded(F.col("stream_id")), F.col("data")))
    return c.as_doc(codecs.filter_checks(rows).where("filter = 'x86'").select("stream_id", "applied", "restored"))


def repeated(data: bytes) -> bytes:
    """data twice, and an arithmetic series."""
    return data + data + (np.arange(400, dtype="<u8") * 7 + 5).tobytes()


@c.query("SELECT doc_id, f AS filter, true AS applied, true AS restored FROM documents, (VALUES ('lzp'), ('delta')) AS x(f) WHERE strlen(text) >= 200")
def filters_planted(spark, sf_dir):
    """Filters over documents that stand twice before a series: all apply and can be undone."""
    rows = kernel(streams.documents(spark, sf_dir).where(F.octet_length("data") >= 200), repeated)
    return c.as_doc(codecs.filter_checks(rows).where("filter IN ('lzp', 'delta')"))


@c.query(f"WITH {SQL_CODED} SELECT doc_id, CASE WHEN applied AND doc_id % 2 = 0 THEN 'x86' END AS filter_name, true AS restored FROM a")
def filters_by_type(spark, sf_dir):
    """Filters chosen by type: documents after bytes like those of machine code, every other one typed as such."""
    rows = streams.documents(spark, sf_dir).withColumn("data", F.concat(coded(F.col("stream_id")), F.col("data")))
    rows = rows.withColumn("subtype", F.when(F.col("stream_id") % 2 == 0, "exe32").otherwise(""))
    made = codecs.filtered(rows)
    back = codecs.unfiltered(made).select("stream_id", F.sha2("data", 256).alias("back"))
    want = rows.select("stream_id", F.sha2("data", 256).alias("want"))
    out = made.select("stream_id", "filter_name").join(back, "stream_id").join(want, "stream_id")
    return c.as_doc(out.select("stream_id", "filter_name", (F.col("back") == F.col("want")).alias("restored")))
