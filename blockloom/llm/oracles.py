"""DuckDB SQL of the rows of those operator queries that SQL can express.

Not among them: language id, sharding and mixing (fitted or drawn), sentencepiece, and secret scans (positions of matches
and zstandard); tests hold these against brute force.
"""

from __future__ import annotations

from blockloom.llm import chat, quality

WORDS = r"[^\x20\x09-\x0D]+"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i : i + 4], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 4, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 75 * (p.c + q.c - o)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, b.y FROM r JOIN b ON b.x = r.c)
SELECT d.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = d.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS d FROM p),
t AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) ELSE page_id END AS top FROM q)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM t
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
b AS (SELECT a.vec_id AS x, c.vec_id AS y FROM u a JOIN u c ON a.vec_id <> c.vec_id WHERE a.n > 0 AND c.n > 0 AND list_dot_product(a.e, c.e) / (a.n * c.n) >= 0.9),
r(d, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.d, b.y FROM r JOIN b ON b.x = r.c),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d), k AS (SELECT x, count(*) AS n FROM b GROUP BY x)
SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept FROM v JOIN m ON m.d = v.vec_id LEFT JOIN k ON k.x = v.vec_id
"""


def _repeats(n: int) -> str:
    """Per document the words, and their characters, in n-word windows found twice or more."""
    return f"""g{n} AS (SELECT doc_id, i, array_to_string(l[i : i + {n - 1}], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - {n - 2})) AS i FROM w WHERE len(l) >= {n})),
r{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{n}),
p{n} AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS k FROM r{n} WHERE c > 1),
c{n} AS (SELECT doc_id, count(*) AS words, sum(length(l[k])) AS chars FROM p{n} JOIN w USING (doc_id) GROUP BY doc_id)"""


LENGTHS = [n for n, _ in quality.COVERAGE]
RULES = [(f"dup_{n}gram", f"dup_{n}gram_chars > CAST({most} AS DOUBLE) * word_chars") for n, most in quality.COVERAGE]
RULES.append(("dup_line", f"dup_line_chars > CAST({quality.MAX_LINE_SHARE} AS DOUBLE) * word_chars"))
QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS l FROM documents),
{", ".join(_repeats(n) for n in (quality.WINDOW, *LENGTHS))},
s AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
d AS (SELECT doc_id, line, count(*) - 1 AS again FROM s WHERE regexp_matches(line, '{WORDS}') GROUP BY ALL),
y AS (SELECT doc_id, sum(again) AS n, sum(again * length(array_to_string(regexp_extract_all(line, '{WORDS}'), ''))) AS chars FROM d GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(length(array_to_string(l, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(y.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c{quality.WINDOW}.words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(y.chars, 0) AS BIGINT) AS dup_line_chars,
  {", ".join(f"CAST(coalesce(c{n}.chars, 0) AS BIGINT) AS dup_{n}gram_chars" for n in LENGTHS)}
  FROM w LEFT JOIN y USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in (quality.WINDOW, *LENGTHS))}),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  concat_ws(',', {", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in RULES)}) AS failed FROM m)
SELECT *, NOT base_failed AND failed = '' AS kept FROM f
"""

ORACLES = {"op1_ngram_jaccard_join": JACCARD, "op2_chat_formatting": chat.QUERY_SQL, "op5_warc": WARC, "op6_quality_rules": QUALITY, "op7_embedding_near_dedup": VECTORS}
