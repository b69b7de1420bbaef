"""Every operator as a query over the test tables, with DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.functions import content, sizes
from blockloom.operators import archive, chunking, codecs, dedupe, delta, dictionary, rebuild, secrecy, similarity
from blockloom.shared import kept, mapped, shared_dir
from blockloom.sources import streams
from blockloom.streaming import dedupe as streaming

BLOCK = 2048
SMALL = 256
PER_SEGMENT = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql_blocks(size: int) -> str:
    return f"""d AS (SELECT doc_id, source, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 0),
u AS (SELECT *, unnest(range(0, (n + {size - 1}) // {size})) AS block_no FROM d),
b AS (SELECT doc_id, source, block_no, block_no * {size} AS "offset", least({size}, n - block_no * {size}) AS length,
             sha256(unhex(substr(h, 1 + 2 * {size} * block_no, 2 * {size}))) AS cksum FROM u)"""


def sql_refs(size: int) -> str:
    return sql_blocks(size) + """,
r AS (SELECT *, first_value(doc_id) OVER w AS ref_stream, first_value(block_no) OVER w AS ref_block FROM b
      WINDOW w AS (PARTITION BY cksum, length ORDER BY doc_id, block_no)),
k AS (SELECT *, CASE WHEN doc_id = ref_stream AND block_no = ref_block THEN 'literal' ELSE 'exact' END AS kind FROM r)"""


def blocks(spark: SparkSession, sf_dir: str, size: int = SMALL, data: bool = False) -> DataFrame:
    return chunking.fixed_blocks(streams.documents(spark, sf_dir), size, data)


def as_doc(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("stream_id", "doc_id")


# deduplication

@query(f'WITH {sql_blocks(BLOCK)} SELECT doc_id, block_no, "offset", length, cksum FROM b')
def fixed_blocks(spark, sf_dir):
    return as_doc(blocks(spark, sf_dir, BLOCK))


SUMMARY = """SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n_blocks, CAST(coalesce(sum(c * length), 0) AS BIGINT) AS n_bytes, count(*) AS n_unique,
CAST(coalesce(sum(c) - count(*), 0) AS BIGINT) AS dup_blocks, CAST(coalesce(sum((c - 1) * length), 0) AS BIGINT) AS dup_bytes
FROM (SELECT cksum, length, count(*) AS c FROM b GROUP BY ALL)"""


@query(f"WITH {sql_blocks(BLOCK)} {SUMMARY}")
def fixed_dedupe_summary(spark, sf_dir):
    return dedupe.summary(blocks(spark, sf_dir, BLOCK))


@query(f"WITH {sql_blocks(SMALL)} {SUMMARY}")
def fixed_dedupe_summary_small(spark, sf_dir):
    return dedupe.summary(blocks(spark, sf_dir))


@query(f'WITH {sql_refs(SMALL)} SELECT doc_id, block_no, "offset", length, kind, ref_stream, ref_block FROM k')
def fixed_dedupe_refs(spark, sf_dir):
    return as_doc(dedupe.references(blocks(spark, sf_dir)).drop("cksum"))


@query(f"""WITH {sql_blocks(64)}, r AS (SELECT *, min(block_no) OVER (PARTITION BY doc_id, cksum, length) AS ref_block FROM b)
SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (block_no <> ref_block) AS dup_blocks FROM r GROUP BY doc_id""")
def chunk_dedupe(spark, sf_dir):
    refs = dedupe.references(blocks(spark, sf_dir, 64), ["stream_id"])
    return as_doc(refs.groupBy("stream_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("kind") == "exact").alias("dup_blocks")))


@query(f"""WITH {sql_refs(SMALL)}, l AS (SELECT *, block_no - row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS g FROM k WHERE kind = 'literal'),
e AS (SELECT doc_id, g, min(block_no) AS first_block, min("offset") AS start, CAST(sum(length) AS BIGINT) AS length, count(*) AS n_blocks FROM l GROUP BY doc_id, g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_block) AS run, first_block, start, length, n_blocks FROM e""")
def dedupe_unique_runs(spark, sf_dir):
    out = dedupe.unique_runs(dedupe.references(blocks(spark, sf_dir)))
    return as_doc(out.withColumn("run", F.col("run").cast("long")))


@query(f"""WITH {sql_refs(SMALL)}, l AS (SELECT *, lag(block_no) OVER (PARTITION BY doc_id ORDER BY block_no) AS was FROM k WHERE kind = 'literal')
SELECT (SELECT count(*) FROM k WHERE length >= {SMALL}) AS max_length_blocks, count(*) AS literals, count(*) FILTER (block_no = was + 1) AS merged FROM l""")
def dedupe_detail(spark, sf_dir):
    return dedupe.detail(dedupe.references(blocks(spark, sf_dir)), SMALL)


@query(f"""WITH {sql_refs(SMALL)}, s AS (SELECT doc_id, count(*) AS n_blocks, CAST(sum(CASE WHEN kind = 'exact' THEN length ELSE 0 END) AS BIGINT) AS saved FROM k GROUP BY doc_id)
SELECT *, n_blocks * 4 AS index_bytes, n_blocks > 2 AND saved >= n_blocks * 4 AS worthwhile FROM s""")
def dedupe_worthwhile(spark, sf_dir):
    return as_doc(dedupe.worthwhile(dedupe.references(blocks(spark, sf_dir))))


@query(f"""WITH {sql_blocks(SMALL)}, o AS (SELECT DISTINCT cksum, length FROM b WHERE source <> 'src0'), m AS (SELECT * FROM b WHERE source = 'src0')
SELECT 'known' AS side, count(*) AS n, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes FROM m SEMI JOIN o USING (cksum, length)
UNION ALL SELECT 'new', count(*), CAST(coalesce(sum(length), 0) AS BIGINT) FROM m ANTI JOIN o USING (cksum, length)""")
def dedupe_known_blocks(spark, sf_dir):
    docs = streams.table(spark, sf_dir, "documents")
    cut = lambda d: chunking.fixed_blocks(streams.text_streams(d, "doc_id", "text"), SMALL)
    known, new = dedupe.split_known(cut(docs.where("source = 'src0'")), cut(docs.where("source <> 'src0'")))
    total = lambda d, side: d.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return total(known, "known").unionByName(total(new, "new"))


@query(f"""WITH {sql_refs(SMALL)} SELECT k.source, count(*) AS n_blocks, CAST(sum(k.length) AS BIGINT) AS n_bytes,
CAST(sum(CASE WHEN kind = 'exact' AND f.source <> k.source THEN k.length ELSE 0 END) AS BIGINT) AS from_others,
CAST(sum(CASE WHEN kind = 'exact' AND f.source = k.source THEN k.length ELSE 0 END) AS BIGINT) AS from_itself
FROM k JOIN documents f ON f.doc_id = ref_stream GROUP BY k.source""")
def cross_source_dedupe(spark, sf_dir):
    docs = streams.table(spark, sf_dir, "documents")
    own = docs.select(F.col("doc_id").alias("stream_id"), "source")
    first = docs.select(F.col("doc_id").alias("ref_stream"), F.col("source").alias("ref_source"))
    refs = dedupe.references(blocks(spark, sf_dir)).join(own, "stream_id").join(first, "ref_stream")
    part = lambda test: F.sum(F.when((F.col("kind") == "exact") & test, F.col("length")).otherwise(0))
    same = F.col("source") == F.col("ref_source")
    return refs.groupBy("source").agg(F.count("*").alias("n_blocks"), F.sum("length").alias("n_bytes"), part(~same).alias("from_others"), part(same).alias("from_itself"))


@query("""WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 1)
SELECT count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def union_inputs(spark, sf_dir):
    all_ = streams.documents(spark, sf_dir)
    both = all_.where("stream_id % 2 = 0").unionByName(all_.where("stream_id % 2 = 1"))
    return both.agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("n_bytes"))


# content-defined blocks

CANDIDATES = """WITH d AS (SELECT doc_id, strlen(text) AS n, hex(encode(text)) AS h FROM documents WHERE strlen(text) > 16),
x AS (SELECT doc_id, i, CAST('0x' || substr(h, 1 + 2 * i, 2) AS INTEGER) AS v FROM (SELECT doc_id, h, unnest(range(0, n)) AS i FROM d)),
w AS (SELECT doc_id, i, lag(v, 16) OVER o AS gone, {sum} AS s FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) FILTER (xor(s % 1024, (1 + gone * {weight}) % 1024) = 0) AS n_cuts,
       CAST(coalesce(sum(i) FILTER (xor(s % 1024, (1 + gone * {weight}) % 1024) = 0), 0) AS BIGINT) AS pos_sum
FROM w WHERE gone IS NOT NULL GROUP BY doc_id"""
CANDIDATES = CANDIDATES.format(
    sum=" + ".join(f"{pow(chunking.MULTIPLIER, k, 1024)} * " + ("v" if k == 0 else f"lag(v, {k}) OVER o") for k in range(chunking.WINDOW)),
    weight=int(chunking.LEAVING[1] - 1),
)


@query(CANDIDATES)
def cdc_candidates(spark, sf_dir):
    return as_doc(chunking.candidate_sums(streams.documents(spark, sf_dir).where(F.octet_length("data") > 16)))


@query()
def cdc_blocks(spark, sf_dir):
    return as_doc(chunking.content_blocks(streams.documents(spark, sf_dir), 0))


@query()
def cdc_dedupe_summary(spark, sf_dir):
    return dedupe.summary(chunking.content_blocks(streams.documents(spark, sf_dir), 0))


# content typing

SQL_CLASSES = """SELECT {key}, CAST(strlen(t) AS BIGINT) AS n_bytes, CAST(strlen(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) AS BIGINT) AS hi,
CAST(length(t) - length(regexp_replace(t, '[\\x00-\\x1F]', '', 'g')) AS BIGINT) AS ctl, CAST(length(t) - length(replace(t, ' ', '')) AS BIGINT) AS spaces,
CAST(length(t) - length(replace(t, '<', '')) AS BIGINT) AS lt, CAST(length(t) - length(replace(t, '>', '')) AS BIGINT) AS gt,
CAST((length(s) - length(replace(s, '</', ''))) // 2 + (length(s) - length(replace(s, '/>', ''))) // 2 AS BIGINT) AS tags
FROM (SELECT {key}, coalesce({text}, '') AS t, replace(coalesce({text}, ''), ' ', '') AS s FROM {table})"""
DOC_CLASSES = SQL_CLASSES.format(key="doc_id", text="text", table="documents")
PAGE_CLASSES = SQL_CLASSES.format(key="page_id", text="html", table="pages")
EIGHTHS = "(n_bytes // 2 + n_bytes // 4 + n_bytes // 8)"
SQL_MARKUP = "gt >= 4 AND lt > gt - 4 AND lt < gt + 4 AND 10 * tags > 4 * lt AND 100 * (lt + gt) > 6 * spaces"


def classed(spark: SparkSession, sf_dir: str, name: str, key: str, text: str) -> DataFrame:
    df = streams.table(spark, sf_dir, name)
    return df.select(key, *(c.alias(n) for n, c in content.byte_classes(F.coalesce(F.col(text), F.lit(""))).items()))


@query(DOC_CLASSES)
def byte_classes(spark, sf_dir):
    return classed(spark, sf_dir, "documents", "doc_id", "text")


@query(f"""SELECT page_id, CASE WHEN 10 * hi <= n_bytes AND ctl < {EIGHTHS} THEN 'text' ELSE 'binary' END AS ten,
CASE WHEN 10 * (hi + ctl) > 3 * n_bytes THEN 'binary' ELSE 'text' END AS thirty, CASE WHEN 10 * (hi + ctl) > 5 * n_bytes THEN 'binary' ELSE 'text' END AS fifty FROM ({PAGE_CLASSES})""")
def text_binary_verdict(spark, sf_dir):
    v = content.verdicts()
    return classed(spark, sf_dir, "pages", "page_id", "html").select("page_id", *(v[k].alias(k) for k in ("ten", "thirty", "fifty")))


@query(f"SELECT page_id, {SQL_MARKUP} AS markup FROM ({PAGE_CLASSES})")
def markup_verdict(spark, sf_dir):
    return classed(spark, sf_dir, "pages", "page_id", "html").select("page_id", content.verdicts()["markup"].alias("markup"))


@query(f"SELECT page_id, CASE WHEN 10 * hi <= n_bytes AND ctl < {EIGHTHS} THEN 'text' ELSE 'unknown' END AS kind FROM ({PAGE_CLASSES})")
def simple_text_test(spark, sf_dir):
    return classed(spark, sf_dir, "pages", "page_id", "html").select("page_id", content.simple_text().alias("kind"))


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages with the verdict of each adaptive mode, and markup as the subtype."""
    v = content.verdicts()
    docs = classed(spark, sf_dir, "documents", "doc_id", "text").withColumn("id", F.concat(F.lit("d"), "doc_id"))
    pages = classed(spark, sf_dir, "pages", "page_id", "html").withColumn("id", F.concat(F.lit("p"), "page_id"))
    rows = docs.drop("doc_id").unionByName(pages.drop("page_id"))
    return rows.select("id", v["thirty"].alias("thirty"), v["fifty"].alias("fifty"), F.when(v["markup"], content.MARKUP).otherwise("").alias("subtype"))


SQL_KINDS = f"""k AS (SELECT id, CASE WHEN 10 * (hi + ctl) > 3 * n_bytes THEN 'binary' ELSE 'text' END AS thirty,
CASE WHEN 10 * (hi + ctl) > 5 * n_bytes THEN 'binary' ELSE 'text' END AS fifty, {SQL_MARKUP} AS m FROM (
SELECT 'd' || doc_id AS id, * EXCLUDE doc_id FROM ({DOC_CLASSES}) UNION ALL SELECT 'p' || page_id, * EXCLUDE page_id FROM ({PAGE_CLASSES}))),
c AS (SELECT id, CASE WHEN fifty = 'text' AND NOT m OR fifty = 'binary' AND m THEN 'ppmd' WHEN fifty = 'binary' THEN 'bzip2' ELSE 'ppmd' END AS adapt,
CASE WHEN thirty = 'text' AND NOT m OR thirty = 'binary' AND m THEN 'libbsc' WHEN thirty = 'binary' THEN 'lzma' ELSE 'ppmd' END AS adapt2 FROM k)"""


@query(f"WITH {SQL_KINDS} SELECT id, adapt, adapt2 FROM c")
def adaptive_codec_choice(spark, sf_dir):
    rows = kinds(spark, sf_dir)
    return rows.select("id", content.adaptive_codec("adapt", F.col("fifty"), F.col("subtype")).alias("adapt"), content.adaptive_codec("adapt2", F.col("thirty"), F.col("subtype")).alias("adapt2"))


@query(f"WITH {SQL_KINDS} SELECT adapt, adapt2, count(*) AS n FROM c GROUP BY ALL")
def codec_usage(spark, sf_dir):
    return adaptive_codec_choice(spark, sf_dir).groupBy("adapt", "adapt2").agg(F.count("*").alias("n"))


# archive members

NAMES = sorted(content.EXTENSIONS)
NAME_LIST = ", ".join(f"'{n}'" for n in NAMES)
SQL_MEMBERS = f"""m AS (
SELECT source || '/d' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '.' || [{NAME_LIST}][1 + doc_id % {len(NAMES)}] END AS path, CAST(strlen(text) AS BIGINT) AS size, source AS part, doc_id AS no FROM documents
UNION ALL SELECT 'parts/' || replace(lower(p_brand), '#', '') || '/a/b/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.' || [{NAME_LIST}][1 + p_partkey % {len(NAMES)}] ELSE '' END, CAST(p_size AS BIGINT), 'parts', p_partkey FROM part)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member paths with and without extension, made of documents and parts: path, size, part, no."""
    ext = lambda c: F.element_at(F.array(*map(F.lit, NAMES)), (F.col(c) % len(NAMES) + 1).cast("int"))
    docs = streams.table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/d"), "doc_id", F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("."), ext("doc_id")))).alias("path"),
        F.octet_length("text").cast("long").alias("size"), F.col("source").alias("part"), F.col("doc_id").alias("no"))
    parts = streams.table(spark, sf_dir, "part").select(
        F.concat(F.lit("parts/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("/a/b/"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), ext("p_partkey"))).otherwise("")).alias("path"),
        F.col("p_size").cast("long").alias("size"), F.lit("parts").alias("part"), F.col("p_partkey").alias("no"))
    return docs.unionByName(parts)


SQL_TYPES = "t(ext, primary_, subtype) AS (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in sorted(content.EXTENSIONS.items())) + ")"
SQL_TYPED = f"""{SQL_MEMBERS}, {SQL_TYPES}, e AS (SELECT *, lower(CASE WHEN contains(split_part(path, '/', -1), '.') THEN split_part(path, '.', -1) ELSE '' END) AS x FROM m),
y AS (SELECT path, size, part, no, CASE WHEN length(x) <= 8 THEN x ELSE '' END AS ext, coalesce(primary_, 'unknown') AS prim, coalesce(subtype, '') AS subtype FROM e LEFT JOIN t ON t.ext = x AND length(x) <= 8)"""


@query(f"WITH {SQL_TYPED} SELECT path, ext, prim, subtype FROM y")
def type_by_extension(spark, sf_dir):
    return content.type_by_extension(members(spark, sf_dir)).select("path", "ext", F.col("primary").alias("prim"), "subtype")


LEVELS = (1, 6, 9)
SQL_SKIPS = " UNION ALL ".join(
    f"SELECT '{c}' AS codec, {lv} AS level, subtype, count(*) AS n, count(*) FILTER (prim = 'compressed' AND {lv} < {below} AND "
    + (f"subtype IN ({', '.join(map(repr, refused))})" if taken == ("*",) else f"subtype NOT IN ({', '.join(map(repr, taken)) or 'NULL'})" if taken else "true")
    + ") AS skipped FROM y GROUP BY subtype"
    for c, (below, taken, refused) in content.SKIP_RULES.items()
    for lv in LEVELS
)


@query(f"WITH {SQL_TYPED} {SQL_SKIPS}")
def codec_skip_rules(spark, sf_dir):
    rows = content.type_by_extension(members(spark, sf_dir)).groupBy("primary", "subtype").agg(F.count("*").alias("c"))
    rules = F.explode(F.array(*(F.struct(F.lit(c).alias("codec"), F.lit(lv).alias("level"), content.codec_skips(c, F.lit(lv), F.col("primary"), F.col("subtype")).alias("skips")) for c in content.SKIP_RULES for lv in LEVELS)))
    rows = rows.withColumn("r", rules).select("r.*", "subtype", "c")
    return rows.groupBy("codec", "level", "subtype").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("skips"), F.col("c")).otherwise(0)).alias("skipped"))


@query(f"""WITH {SQL_TYPED}, z AS (SELECT *, subtype IN ('packjpg', 'audio_compressed') AS inc, prim = 'text' AND subtype <> 'markup' OR prim = 'binary' AND subtype = 'markup' OR subtype IN ({', '.join(map(repr, content.BLOCK_SORTED))}) AS sorts FROM y)
SELECT prim, subtype, inc, sorts, count(*) AS n FROM z GROUP BY ALL""")
def content_predicates(spark, sf_dir):
    rows = content.type_by_extension(members(spark, sf_dir))
    rows = rows.select(F.col("primary").alias("prim"), "subtype", F.col("subtype").isin(*content.INCOMPRESSIBLE).alias("inc"), content.block_sort_preferred(F.col("primary"), F.col("subtype")).alias("sorts"))
    return rows.groupBy("prim", "subtype", "inc", "sorts").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT page_id, (page_id % 6) AS k FROM pages) SELECT k, CASE k WHEN 0 THEN 'binary/pdf' WHEN 1 THEN 'binary/wav' WHEN 2 THEN 'binary/exe64'
WHEN 3 THEN 'binary/jpeg' WHEN 4 THEN 'binary/pnm' ELSE 'unknown' END AS kind, count(*) AS n FROM p GROUP BY ALL""")
def type_by_magic(spark, sf_dir):
    heads = ["%PDF-1.4".encode().hex(), b"RIFF\x01\x01\x01\x01WAVEfmt ".hex(), b"\x7fELF\x02\x01\x01".hex(), b"\xff\xd8\xff\xe0\x00\x10JFIF\x00".hex(), b"P6\n".hex(), b"".hex()]
    rows = streams.table(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % 6)
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("k") + 1).cast("int")))
    kind = content.type_by_magic(F.concat(head, F.encode("html", "UTF-8")))
    return rows.select("k", kind.alias("kind")).groupBy("k", "kind").agg(F.count("*").alias("n"))


SQL_SIZE = "CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN (size // 1024) || ' KB' WHEN size < 1073741824 THEN (size // 1048576) || ' MB' WHEN size < 1099511627776 THEN (size // 1073741824) || ' GB' ELSE size || ' B' END"


@query(f"SELECT id, size, {SQL_SIZE} AS human FROM (SELECT 'd' || doc_id AS id, CAST(strlen(text) AS BIGINT) AS size FROM documents UNION ALL SELECT 'p' || page_id, CAST(strlen(html) AS BIGINT) * 1048576 FROM pages)")
def human_size(spark, sf_dir):
    docs = streams.documents(spark, sf_dir).select(F.concat(F.lit("d"), "stream_id").alias("id"), F.octet_length("data").cast("long").alias("size"))
    pages = streams.pages(spark, sf_dir).select(F.concat(F.lit("p"), "stream_id").alias("id"), (F.octet_length("data").cast("long") * 1048576).alias("size"))
    return docs.unionByName(pages).withColumn("human", sizes.human_size(F.col("size")))


@query("""WITH l AS (SELECT o_orderkey, (o_orderkey % 2000) || ['', 'k', 'M', 'g', 'x'][1 + o_orderkey % 5] AS t FROM orders)
SELECT o_orderkey, t, CASE WHEN regexp_matches(t, '^[0-9]+[kKmMgG]?$') THEN CAST(regexp_extract(t, '^[0-9]+') AS BIGINT) * CASE lower(right(t, 1)) WHEN 'k' THEN 1024 WHEN 'm' THEN 1048576 WHEN 'g' THEN 1073741824 ELSE 1 END END AS bytes FROM l""")
def parsed_size(spark, sf_dir):
    text = F.concat((F.col("o_orderkey") % 2000).cast("string"), F.element_at(F.array(*map(F.lit, ("", "k", "M", "g", "x"))), (F.col("o_orderkey") % 5 + 1).cast("int")))
    return streams.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t")).withColumn("bytes", sizes.parsed_size(F.col("t")))


@query("""SELECT count(*) AS n_chunks, CAST(min(n) AS BIGINT) AS smallest, CAST(max(n) AS BIGINT) AS largest, CAST(sum(n) // count(*) AS BIGINT) AS average
FROM (SELECT strlen(text) AS n FROM documents UNION ALL SELECT strlen(html) FROM pages)""")
def chunk_stats(spark, sf_dir):
    both = streams.documents(spark, sf_dir).unionByName(streams.pages(spark, sf_dir)).select(F.octet_length("data").cast("long").alias("n"))
    return both.agg(F.count("*").alias("n_chunks"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.expr("sum(n) div count(*)").alias("average"))


SQL_KEYS = f"""{SQL_MEMBERS}, s AS (SELECT *, split_part(path, '/', -1) AS nm, length(path) - length(replace(path, '/', '')) AS seps, array_to_string(list_transform(string_split(path, '/'), lambda p: substr(p, 1, 1)), '') AS ini FROM m),
f AS (SELECT *, substr(ini, 2, greatest(seps - 1, 0)) AS fol FROM s),
g AS (SELECT path, size, CASE WHEN contains(nm, '.') THEN 1 ELSE 0 END AS flag, CASE WHEN contains(nm, '.') THEN substr(split_part(nm, '.', -1), 1, 4)
WHEN seps < 4 THEN right(fol || substr(nm, 1, 5 - least(seps, 4)), 4) ELSE right(fol || substr(nm, 1, 1), 4) END AS key FROM f)"""


@query(f"WITH {SQL_KEYS} SELECT path, flag, key, size, row_number() OVER (ORDER BY flag, key, size, path) AS pos FROM g")
def member_order(spark, sf_dir):
    """Positions from ranges: rows are range-partitioned and sorted, and each partition starts where the last ended.

    The ranges are kept, since another run could draw other bounds.
    """
    rows = kept(archive.ordered(members(spark, sf_dir), clustered_only=True).select("path", "flag", "key", "size").withColumn("_p", F.spark_partition_id()))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("flag", "key", "size", "path")))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(before), "_p").select("path", "flag", "key", "size", (F.col("_i") + F.col("_b")).cast("long").alias("pos"))  # a row for each partition


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS size, CASE page_id % 3 WHEN 2 THEN '../' ELSE '' END || url AS path FROM pages")
def archive_listing(spark, sf_dir):
    head = F.element_at(F.array(F.lit("/../"), F.lit("//"), F.lit("../")), (F.col("page_id") % 3 + 1).cast("int"))
    rows = streams.table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("size"), F.concat(head, "url").alias("path"))
    return rows.withColumn("path", archive.normalized(F.col("path")))


@query("SELECT count(*) AS n_members, CAST(sum(strlen(html) + 1024) AS BIGINT) AS total_bytes FROM pages")
def archive_totals(spark, sf_dir):
    return archive.totals(streams.table(spark, sf_dir, "pages").select(F.octet_length("html").cast("long").alias("size")))


@query(f"""WITH {SQL_TYPED}, n AS (SELECT *, CASE WHEN lag(prim) OVER w IS DISTINCT FROM prim OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS nw FROM y WINDOW w AS (PARTITION BY part ORDER BY no)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY part ORDER BY no) AS group_no FROM n)
SELECT part, CAST(group_no AS BIGINT) AS group_no, min(prim) AS kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM g GROUP BY part, group_no""")
def type_change_groups(spark, sf_dir):
    rows = content.type_by_extension(members(spark, sf_dir)).withColumnRenamed("primary", "prim")
    return archive.type_groups(rows, "part", ["no"], "prim")


@query(f"""WITH RECURSIVE {SQL_TYPED}, s AS (SELECT part, prim, size, row_number() OVER (PARTITION BY part ORDER BY no) AS i FROM y),
f(part, i, group_no, kind, bytes) AS (SELECT part, i, CAST(1 AS BIGINT), prim, size FROM s WHERE i = 1 UNION ALL
  SELECT part, i, group_no + CASE WHEN nw THEN 1 ELSE 0 END, CASE WHEN nw THEN prim ELSE kind END, size + CASE WHEN nw THEN 0 ELSE bytes END
  FROM (SELECT s.*, group_no, kind, bytes, prim <> kind AND bytes >= 10000 AS nw FROM f JOIN s ON s.part = f.part AND s.i = f.i + 1))
SELECT part, group_no, min(kind) AS kind, count(*) AS n, max(bytes) AS bytes FROM f GROUP BY part, group_no""")
def type_change_cuts(spark, sf_dir):
    rows = content.type_by_extension(members(spark, sf_dir)).withColumnRenamed("primary", "prim")
    return archive.type_cuts(rows, "part", "no", "prim", 10_000)


@query("SELECT 'd/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS digest FROM documents")
def tar_round_trip(spark, sf_dir):
    rows = streams.documents(spark, sf_dir).select(F.concat(F.lit("d/"), "stream_id", F.lit(".txt")).alias("path"), "data")
    return archive.archive_members(archive.tar_archives(rows, archive.archive_count(rows))).select("path", "size", F.sha2("data", 256).alias("digest"))


@query("SELECT 'p/' || page_id || '.html' AS path, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS digest FROM pages")
def zip_round_trip(spark, sf_dir):
    rows = streams.pages(spark, sf_dir).select(F.concat(F.lit("p/"), "stream_id", F.lit(".html")).alias("path"), "data")
    return archive.archive_members(archive.zip_archives(rows, archive.archive_count(rows))).select("path", "size", F.sha2("data", 256).alias("digest"))


# words

SQL_WORDS = f"""w AS (SELECT unnest(regexp_split_to_array(text, '[\\x00-\\x20.,;:!?()\\[\\]{{}}<>"'']+')) AS r FROM documents),
v AS (SELECT lower(substr(r, 1, 1)) || substr(r, 2) AS word FROM w),
fr AS (SELECT word, count(*) AS n FROM v WHERE strlen(word) BETWEEN {dictionary.WORD_MIN} AND {dictionary.WORD_MAX} GROUP BY word),
ca AS (SELECT word, n, CAST(strlen(word) AS BIGINT) AS len, (n - 1) * (strlen(word) - 1) AS weight FROM fr WHERE n * strlen(word) > {dictionary.LEAST_BYTES} AND n > 1)"""


@query(f"WITH {SQL_WORDS} SELECT word, n FROM fr")
def word_frequency(spark, sf_dir):
    return dictionary.word_frequency(streams.table(spark, sf_dir, "documents"))


@query(f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\\n+')) AS word FROM documents) WHERE strlen(word) BETWEEN {dictionary.WORD_MIN} AND 1024 GROUP BY word""")
def line_frequency(spark, sf_dir):
    """Lines as words, the form for sequence data."""
    return dictionary.word_frequency(streams.table(spark, sf_dir, "documents"), separators=dictionary.LINES, most=1024)


@query(f"WITH {SQL_WORDS} SELECT word, n, len, CAST(weight AS BIGINT) AS weight FROM ca")
def dictionary_candidates(spark, sf_dir):
    return dictionary.candidates(dictionary.word_frequency(streams.table(spark, sf_dir, "documents")))


@query(f"""WITH {SQL_WORDS}, k AS (SELECT *, row_number() OVER (ORDER BY weight DESC, len DESC, encode(word) DESC) - 1 AS rank FROM ca),
z AS (SELECT *, n * len - len - n * CASE WHEN rank = 0 THEN 1 WHEN rank < 217 THEN 2 WHEN rank < 47089 THEN 3 ELSE 4 END AS saving FROM k)
SELECT word, rank, CAST(saving AS BIGINT) AS saving, CAST(sum(saving) OVER (ORDER BY rank) AS BIGINT) AS total_saving FROM z WHERE saving > 0""")
def dictionary_rank(spark, sf_dir):
    out = dictionary.ranked(dictionary_candidates(spark, sf_dir))
    return out.select("word", F.col("rank").cast("long").alias("rank"), "saving", "total_saving")


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS raw_bytes, true AS restored FROM documents")
def dictionary_round_trip(spark, sf_dir):
    words = [r["word"] for r in dictionary_rank(spark, sf_dir).where("rank < 5000").orderBy("rank").select("word").collect()]  # 5000 words
    return as_doc(dictionary.encoded(streams.documents(spark, sf_dir), words)).drop("encoded_bytes")


# differences

def sql_runs(table: str, key: str, value: str, span: int = 4096) -> str:
    return f"""a AS (SELECT {key} // {span} AS chunk, {key} AS k, CAST({value} AS BIGINT) AS v, row_number() OVER (PARTITION BY {key} // {span} ORDER BY {key}, {value}) AS i FROM {table}),
d AS (SELECT *, v - lag(v) OVER (PARTITION BY chunk ORDER BY i) AS d FROM a),
e AS (SELECT *, CASE WHEN d IS NULL OR lag(d) OVER w IS DISTINCT FROM d THEN 1 ELSE 0 END AS nw FROM d WINDOW w AS (PARTITION BY chunk ORDER BY i)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY chunk ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e),
runs AS (SELECT chunk, CAST(run AS BIGINT) AS run, arg_min(v, i) AS start, coalesce(max(d), 0) AS step, count(*) AS n FROM g GROUP BY chunk, run)"""


@query(f"WITH {sql_runs('orders', 'o_orderkey', 'o_orderkey')} SELECT * FROM runs")
def arithmetic_runs(spark, sf_dir):
    return delta.arithmetic_runs(streams.table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderkey"))


@query(f"WITH {sql_runs('lineitem', 'l_orderkey', 'l_orderkey')} SELECT chunk, count(*) AS n_runs, max(n) AS longest, CAST(sum(n) AS BIGINT) AS n_values FROM runs GROUP BY chunk")
def arithmetic_run_summary(spark, sf_dir):
    runs = delta.arithmetic_runs(streams.table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_orderkey"))
    return runs.groupBy("chunk").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"), F.sum("n").alias("n_values"))


@query("SELECT event_id // 4096 AS chunk, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY chunk")
def runs_expand(spark, sf_dir):
    runs = delta.arithmetic_runs(streams.table(spark, sf_dir, "events"), "event_id", F.col("event_id"))
    return delta.expand_runs(runs).groupBy("chunk").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query()
def stride_choice(spark, sf_dir):
    keys = streams.table(spark, sf_dir, "lineitem").withColumn("stream_id", F.expr("l_orderkey div 512"))
    number = F.unhex(F.lpad(F.hex("l_orderkey"), 16, "0"))
    part = keys.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", F.reverse(F.hex(number)).alias("h")))).alias("s"))
    rows = part.select("stream_id", F.unhex(F.array_join(F.transform("s", lambda x: x["h"]), "")).alias("data"))
    costs = delta.stride_costs(rows)
    return costs.groupBy("stream_id").agg(F.min_by("stride", F.struct("cost", "stride")).alias("stride"), F.min("cost").alias("cost"))


@query("""WITH z AS (SELECT l_orderkey, l_linenumber, l_discount = 0 AS t, row_number() OVER w AS pos FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS g FROM z WHERE t) SELECT l_orderkey, min(pos) AS first_pos, count(*) AS n FROM g GROUP BY l_orderkey, g""")
def zero_runs(spark, sf_dir):
    out = delta.value_runs(streams.table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_discount") == 0)
    return out.withColumn("first_pos", F.col("first_pos").cast("long"))


# similarity

SQL_SKETCH = f"""{sql_blocks(SMALL)}, p AS (SELECT DISTINCT doc_id, block_no // {PER_SEGMENT} AS segment_id, substr(cksum, 1 + 16 * j, 16) AS piece FROM b, range(0, 4) AS r(j)),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment_id ORDER BY piece) AS i FROM p),
o AS (SELECT *, first_value((doc_id, segment_id)) OVER (PARTITION BY piece ORDER BY doc_id, segment_id) AS own FROM q WHERE i <= {similarity.SKETCH}),
cand AS (SELECT DISTINCT doc_id, segment_id, own[1] AS ref_stream, own[2] AS ref_segment FROM o WHERE (doc_id, segment_id) > own)"""


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.segments(blocks(spark, sf_dir), PER_SEGMENT)


@query(f"WITH {SQL_SKETCH} SELECT doc_id, segment_id, string_agg(piece, ',' ORDER BY piece) AS sketch FROM q WHERE i <= {similarity.SKETCH} GROUP BY ALL")
def segment_sketch(spark, sf_dir):
    out = similarity.segment_sketches(segmented(spark, sf_dir))
    return as_doc(out.withColumn("sketch", F.array_join("sketch", ",")))


@query(f"WITH {SQL_SKETCH} SELECT * FROM cand")
def segment_candidates(spark, sf_dir):
    return as_doc(similarity.segment_candidates(similarity.segment_sketches(segmented(spark, sf_dir))))


@query(f"""WITH {SQL_SKETCH}, s AS (SELECT *, block_no // {PER_SEGMENT} AS segment_id FROM b),
h AS (SELECT x.doc_id, x.block_no, x.length, min((z.doc_id, z.block_no)) AS r FROM s x JOIN cand c ON c.doc_id = x.doc_id AND c.segment_id = x.segment_id
JOIN s z ON z.doc_id = c.ref_stream AND z.segment_id = c.ref_segment AND z.cksum = x.cksum AND z.length = x.length GROUP BY ALL)
SELECT doc_id, block_no, length, r[1] AS ref_stream, r[2] AS ref_block FROM h""")
def segment_dedupe(spark, sf_dir):
    rows = segmented(spark, sf_dir)
    return as_doc(similarity.segment_dedupe(rows, similarity.segment_candidates(similarity.segment_sketches(rows))))


def sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.with_sketch(blocks(spark, sf_dir, BLOCK, data=True), BLOCK, least=64)


@query()
def similar_blocks(spark, sf_dir):
    return as_doc(similarity.similar_blocks(sketched(spark, sf_dir)))


@query()
def delta_saving(spark, sf_dir):
    """Patches of blocks against the block of a segment candidate: the first at the same position, or else the first anywhere."""
    rows = segmented(spark, sf_dir)
    place = F.struct((F.col("segment_id") != F.col("ref_segment")).alias("moved"), "ref_stream", "ref_segment")
    pairs = similarity.segment_candidates(similarity.segment_sketches(rows)).groupBy("stream_id", "segment_id").agg(F.min(place).alias("r")).select("stream_id", "segment_id", "r.ref_stream", "r.ref_segment")
    data = blocks(spark, sf_dir, BLOCK, data=True).select("stream_id", F.col("block_no").alias("segment_id"), "data")  # PER_SEGMENT small blocks make one
    old = data.select(F.col("stream_id").alias("ref_stream"), F.col("segment_id").alias("ref_segment"), F.col("data").alias("old"))
    both = pairs.join(data.withColumnRenamed("data", "new"), ["stream_id", "segment_id"]).join(old, ["ref_stream", "ref_segment"])
    return as_doc(delta.patches(both.withColumnRenamed("segment_id", "block_no")))


# rebuilding, codecs, digests, secrecy

@query("SELECT doc_id, true AS equal FROM documents")
def rebuild_verify(spark, sf_dir):
    cut = blocks(spark, sf_dir, data=True)
    store = rebuild.stored(dedupe.references(cut.drop("data")), cut)
    return as_doc(rebuild.verified(streams.documents(spark, sf_dir), rebuild.rebuilt(store)))


@query("SELECT doc_id, true AS equal FROM documents")
def cdc_rebuild_verify(spark, sf_dir):
    cut = chunking.content_blocks(streams.documents(spark, sf_dir), 0, keep_data=True)
    store = rebuild.stored(dedupe.references(cut.drop("data")), cut)
    return as_doc(rebuild.verified(streams.documents(spark, sf_dir), rebuild.rebuilt(store)))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS digest FROM documents")
def digest_manifest(spark, sf_dir):
    return as_doc(streams.documents(spark, sf_dir).select("stream_id", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest")))


def all_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunks(streams.documents(spark, sf_dir), 1 << 20)
    return codecs.encoded(rows, F.array(*map(F.lit, codecs.CODECS)), 3, ("x86", "lzp", "delta"))


@query()
def compressed_size_by_codec(spark, sf_dir):
    return codecs.usage(all_codecs(spark, sf_dir))


@query("SELECT c.codec, count(*) AS n, 0 AS errors, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents, (VALUES " + ", ".join(f"('{c}')" for c in codecs.CODECS) + ") AS c(codec) WHERE strlen(text) > 0 GROUP BY c.codec")
def codec_round_trip(spark, sf_dir):
    coded = all_codecs(spark, sf_dir)
    back = codecs.decoded(coded.withColumn("stream_id", F.concat_ws(" ", "codec_requested", "stream_id")), keep_data=False)
    return back.groupBy(F.substring_index("stream_id", " ", 1).alias("codec")).agg(F.countDistinct("stream_id").alias("n"), F.count_if(F.col("error").isNotNull()).cast("int").alias("errors"), F.sum("length").alias("n_bytes"))


@query("SELECT doc_id, true AS opened, true AS refused FROM documents")
def encryption_round_trip(spark, sf_dir):
    key, other = (secrecy.derived_key(p, b"fixed salt for tests") for p in ("one", "two"))
    rows = streams.documents(spark, sf_dir).withColumn("sealed", secrecy.sealed(F.col("data"), key, F.col("stream_id")))
    return rows.select(F.col("stream_id").alias("doc_id"), (secrecy.opened(F.col("sealed"), key, F.col("stream_id")) == F.col("data")).alias("opened"), secrecy.opened_or_null(F.col("sealed"), other, F.col("stream_id")).isNull().alias("refused"))


# streams

@query(f"WITH {sql_refs(BLOCK)} SELECT doc_id, block_no, length, cksum, kind, ref_stream, ref_block FROM k")
def streaming_dedupe(spark, sf_dir):
    """Blocks of documents as a file stream, deduplicated against an index of those before; only digests are kept.

    All files are there before the stream starts and make one micro-batch, so the first occurrence is that of the table.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4()}"
    blocks(spark, sf_dir, BLOCK).write.parquet(f"{folder}/in")
    source = streams.stream_of(spark, f"{folder}/in", "stream_id long, block_no long, offset long, length long, cksum string")
    return as_doc(streaming.references_to_table(spark, source, f"{folder}/out", f"{folder}/index", f"{folder}/state"))


@query("""WITH h AS (SELECT hex(encode(text)) AS h, strlen(text) AS n FROM benchmark), b AS (SELECT substr(h, 1 + 2 * i, 2) AS x FROM (SELECT h, unnest(range(0, n)) AS i FROM h))
SELECT CAST('0x' || x AS INTEGER) AS byte, count(*) AS n FROM b GROUP BY x""")
def byte_histogram(spark, sf_dir):
    return codecs.byte_histogram(streams.text_streams(streams.table(spark, sf_dir, "benchmark"), "item_id", "text"))


@query("SELECT p.page_id, f.f AS filter, true AS restored FROM pages p, (VALUES ('x86'), ('lzp'), ('delta'), ('zero_runs'), ('transpose')) AS f(f)")
def filter_round_trip(spark, sf_dir):
    return codecs.filter_checks(streams.pages(spark, sf_dir)).select(F.col("stream_id").alias("page_id"), "filter", "restored")


#: HMAC by its definition, with a key of 64 bytes or fewer.
MAC_KEY = b"a key for tests"
PADS = [bytes(b ^ pad for b in MAC_KEY.ljust(64, b"\0")).hex().upper() for pad in (0x36, 0x5C)]


@query(f"SELECT doc_id, sha256(unhex('{PADS[1]}' || sha256(unhex('{PADS[0]}' || hex(encode(text)))))) AS mac FROM documents")
def mac_manifest(spark, sf_dir):
    return as_doc(codecs.keyed_macs(streams.documents(spark, sf_dir), MAC_KEY))


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents decoded again, after every tenth document's were damaged."""
    coded = codecs.encoded(chunking.chunks(streams.documents(spark, sf_dir), 1 << 20), F.lit("zlib"))
    hurt = F.concat(F.lit(b"\0").cast("binary"), F.col("data"))
    return codecs.decoded(coded.withColumn("data", F.when(F.col("stream_id") % 10 == 0, hurt).otherwise(F.col("data"))), keep_data=False)


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'crc' END AS error, count(*) AS n FROM documents WHERE strlen(text) > 0 GROUP BY 1")
def error_quarantine(spark, sf_dir):
    """Chunks of every tenth document are damaged; what verification says, counted."""
    return damaged(spark, sf_dir).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT doc_id, strlen(text) AS n FROM documents WHERE false")
def x86_blocks(spark, sf_dir):
    """Documents that look like machine code: none of the texts does."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            on = pa.array([codecs.x86_block(d.as_py()) for d in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d.as_py()) for d in batch.column(1)], pa.int64())], names=["doc_id", "n"]).filter(on)

    return streams.documents(spark, sf_dir).transform(mapped, run, "doc_id long, n long")


@query("SELECT doc_id, unnest(range(0, (strlen(text) + 1048575) // 1048576)) AS chunk_no, 'crc' AS error FROM documents WHERE doc_id % 10 = 0 AND strlen(text) > 0")
def error_list(spark, sf_dir):
    """The chunks that error_quarantine counts, one by one."""
    return as_doc(damaged(spark, sf_dir).where("error IS NOT NULL").select("stream_id", "chunk_no", "error"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    """The batch form of the windowed counts that the streaming module offers."""
    events = streams.table(spark, sf_dir, "events")
    return streaming.late_counts(events).select("event_type", F.col("window.start").alias("hour"), "n")


from blockloom.plans import runs  # noqa: E402, F401  (adds its queries to the dictionaries above)
