"""Preference formatting of chat conversations, with DataFrame functions alone.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text, turn by turn)
is rendered once as the prompt, and what follows as two completions. Each completion comes with its mask: spans of code
points, "start-end" joined by commas, of the assistant's words, on which a loss applies; all else is context.

Conversations without preference labels make pairs by mismatched_replies(): a conversation is chosen over itself with the
last reply of its neighbour in place of its own.

Defined results: turns are ordered by turn, then role and text, nulls first, and counted from there, so gaps in turn do
not matter; a repeated turn row stays a turn; a null role or text counts as empty; a null conversation id is dropped, as
it names no conversation; a conversation without a partner gives a pair whose other side is null, an empty prompt and
its whole self as completion; equal conversations give two empty completions; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def turns_in_order(turns: DataFrame, pair: Column, side: Column) -> DataFrame:
    """Turns with pair_id, side (0 chosen, 1 rejected) and pos from 0 inside the conversation."""
    turns = turns.where(F.col("conv_id").isNotNull()).select(pair.alias("pair_id"), side.alias("side"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("pair_id", "side", "conv_id").orderBy("turn", "role", "text")
    return turns.withColumn("pos", F.row_number().over(order) - 1)


def mismatched_replies(turns: DataFrame) -> DataFrame:
    """turns with pair_id and side: each conversation as it is (side 0), and with another last reply (side 1).

    The reply is the last one of the neighbour, the conversation whose id differs in the lowest bit; rows of side 1 have
    the neighbour's conv_id. A reply is a turn of the assistant; the last one is that of the largest turn, then text, and
    rows equal in both are replaced together. A conversation without a reply, or whose neighbour has none, has no side 1;
    one whose last reply is its neighbour's too makes two equal sides.
    """
    turns = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    last = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("last.text").alias("reply"))
    replies = last.join(other, "conv_id")
    own = (F.col("role") == "assistant") & F.col("turn").eqNullSafe(F.col("last.turn")) & (F.col("text") == F.col("last.text"))
    rejected = turns.join(replies, "conv_id").withColumn("text", F.when(own, F.col("reply")).otherwise(F.col("text")))
    chosen = turns.select(F.col("conv_id").alias("pair_id"), F.lit(0).alias("side"), "conv_id", "turn", "role", "text")
    return chosen.unionByName(rejected.select(F.col("conv_id").alias("pair_id"), F.lit(1).alias("side"), F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), "turn", "role", "text"))


def preference_pairs(turns: DataFrame, pair: Column | None = None, side: Column | None = None) -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected and their masks.

    pair and side are expressions over the columns of turns; by default conversations 2k and 2k+1 are the chosen and the
    rejected one of pair k.
    """
    pair = F.shiftright("conv_id", 1) if pair is None else pair
    side = F.pmod(F.col("conv_id"), F.lit(2)).cast("int") if side is None else side
    rows = turns_in_order(turns, pair, side)
    # a position is common if both sides have it with equal role and text; the prefix ends before the first that is not
    at = rows.groupBy("pair_id", "pos").agg(F.count("*").alias("n"), F.min(F.struct("role", "text")).alias("low"), F.max(F.struct("role", "text")).alias("high"))
    common = (F.col("n") == 2) & (F.col("low") == F.col("high"))
    prefix = at.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~common, F.col("pos"))), F.max("pos") + 1).alias("n_prompt"))
    ids = rows.groupBy("pair_id").agg(F.min(F.when(F.col("side") == 0, F.col("conv_id"))).alias("chosen_id"), F.min(F.when(F.col("side") == 1, F.col("conv_id"))).alias("rejected_id"))
    rows = rows.join(prefix, "pair_id")
    shared = F.col("pos") < F.col("n_prompt")
    # the prompt is rendered from the chosen side alone
    rows = rows.where(~shared | (F.col("side") == 0)).withColumn("part", F.when(shared, F.lit("prompt")).when(F.col("side") == 0, "chosen").otherwise("rejected"))
    rows = rows.withColumns({"head": head(F.col("role")), "body": F.concat("text", F.lit(CLOSE)), "chars": F.char_length("text")})
    before = Window.partitionBy("pair_id", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begins", F.coalesce(F.sum(F.char_length("head") + F.char_length("body")).over(before), F.lit(0)) + F.char_length("head"))
    span = F.when(F.col("role") == "assistant", F.concat(F.col("begins").cast("string"), F.lit("-"), (F.col("begins") + F.col("chars")).cast("string")))
    parts = rows.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "head", "body", span.alias("span")))).alias("t"))
    parts = parts.withColumn("rendered", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"])), ""))
    parts = parts.withColumn("mask", F.array_join(F.transform("t", lambda x: x["span"]), ","))
    pick = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    wide = parts.groupBy("pair_id").agg(*(pick(p, "rendered").alias(p) for p in ("prompt", "chosen", "rejected")), *(pick(p, "mask").alias(f"{p}_mask") for p in ("chosen", "rejected")))
    out = ids.join(prefix, "pair_id").join(wide, "pair_id")
    side_or_null = lambda c, id_: F.when(F.col(id_).isNotNull(), F.coalesce(F.col(c), F.lit("")))
    return out.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_prompt").cast("long").alias("n_prompt_turns"), F.coalesce("prompt", F.lit("")).alias("prompt"),
        *(side_or_null(c, i).alias(c) for c, i in (("chosen", "chosen_id"), ("chosen_mask", "chosen_id"), ("rejected", "rejected_id"), ("rejected_mask", "rejected_id"))),
    )


#: The rows of mismatched_replies(), to go before ORACLE_SQL's own.
MISMATCHED_SQL = """
WITH own AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ends AS (SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, text DESC) AS r FROM own WHERE role = 'assistant') WHERE r = 1),
given AS (
  SELECT conv_id AS pair_id, 0 AS side, * FROM own
  UNION ALL
  SELECT o.conv_id, 1, xor(o.conv_id, 1), o.turn, o.role,
         CASE WHEN o.role = 'assistant' AND o.turn IS NOT DISTINCT FROM e.turn AND o.text = e.text THEN n.text ELSE o.text END
  FROM own o JOIN ends e ON e.conv_id = o.conv_id JOIN ends n ON n.conv_id = xor(o.conv_id, 1)
), """

ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), both_sides AS (
  SELECT pair_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS common
  FROM t GROUP BY pair_id, pos
), prefix AS (
  SELECT pair_id, coalesce(min(CASE WHEN NOT common THEN pos END), max(pos) + 1) AS n_prompt FROM both_sides GROUP BY pair_id
), r AS (
  SELECT t.*, n_prompt, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body,
         CASE WHEN pos < n_prompt THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part
  FROM t JOIN prefix USING (pair_id)
), kept AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins
  FROM r WHERE part <> 'prompt' OR side = 0
), parts AS (
  SELECT pair_id, part, string_agg(head || body, '' ORDER BY pos) AS rendered,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN CAST(CAST(begins AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins AS BIGINT) + length(text) AS VARCHAR) END, ',' ORDER BY pos), '') AS mask
  FROM kept GROUP BY pair_id, part
), ids AS (
  SELECT pair_id, min(CASE WHEN side = 0 THEN conv_id END) AS chosen_id, min(CASE WHEN side = 1 THEN conv_id END) AS rejected_id
  FROM t GROUP BY pair_id
)
SELECT i.pair_id, chosen_id, rejected_id, n_prompt AS n_prompt_turns, coalesce(p.rendered, '') AS prompt,
       CASE WHEN chosen_id IS NOT NULL THEN coalesce(c.rendered, '') END AS chosen,
       CASE WHEN chosen_id IS NOT NULL THEN coalesce(c.mask, '') END AS chosen_mask,
       CASE WHEN rejected_id IS NOT NULL THEN coalesce(j.rendered, '') END AS rejected,
       CASE WHEN rejected_id IS NOT NULL THEN coalesce(j.mask, '') END AS rejected_mask
FROM ids i JOIN prefix f ON f.pair_id = i.pair_id
LEFT JOIN parts p ON p.pair_id = i.pair_id AND p.part = 'prompt'
LEFT JOIN parts c ON c.pair_id = i.pair_id AND c.part = 'chosen'
LEFT JOIN parts j ON j.pair_id = i.pair_id AND j.part = 'rejected'
"""

QUERY_SQL = MISMATCHED_SQL + ORACLE_SQL.replace("WITH t AS", "t AS").replace("conv_id // 2 AS pair_id, conv_id % 2 AS side", "pair_id, side").replace("PARTITION BY conv_id ORDER", "PARTITION BY pair_id, side, conv_id ORDER").replace("FROM conversations", "FROM given").lstrip()
