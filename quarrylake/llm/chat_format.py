"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation (each role but system) the dialogue is rendered once with that speaker as the assistant,
all others as named users and system turns as they are; the mask covers what the assistant says, with its end
marker. A conversation is cut into parts of turns_per_part turns. Where a turn has more utterances than that, they are dealt to pieces of about
as many each by a digest of what is said, so that no group grows with the input; offsets count from the part's start. Rows that repeat travel as
one with their number until they are dealt.

Defined results: an utterance that repeats (same conversation, turn, role and text) is rendered as often as it is said; utterances that share a turn are ordered by
role, then text; null text is empty; a very long text stays whole; columns other than conv_id, turn, role and text are not looked at, whatever their names; null role is the participant "unknown"; a null turn comes first; a null conv_id is a conversation
of its own; a conversation of system turns alone is rendered once, for no one (perspective null), without a mask;
"<|" in a text becomes "< |", so that no text can end its own turn; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of

TURNS_PER_PART = 256


def perspectives(turns: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """One row for each conversation, perspective and part: conv_id, perspective, part, piece, n_turns, rendered, mask, n_masked.
    mask: array of [start, end) offsets of the assistant's text, in characters."""
    # repeated utterances fold into one before anything is dealt by conversation
    said = turns.select("conv_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.replace(text_of(), F.lit("<|"), F.lit("< |")).alias("text"))
    said = said.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    who = said.where("role <> 'system'").select(F.col("conv_id").alias("__conv"), F.col("role").alias("perspective")).distinct()
    # only crowded turns need pieces: few rows, each of more than turns_per_part utterances
    crowded = said.groupBy(F.col("conv_id").alias("__c"), F.col("turn").alias("__t")).agg(F.ceil(F.sum("times") / turns_per_part).alias("pieces")).where("pieces > 1")
    said = said.join(crowded, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("turn") == F.col("__t")), "left").drop("__c", "__t")
    # the copies of an utterance, in two steps so that no array is long
    said = said.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {turns_per_part}"))))
    said = said.withColumn("nth", F.explode(F.sequence(F.col("run") * turns_per_part, F.least(F.col("times"), (F.col("run") + 1) * turns_per_part) - 1)))
    dealt = F.conv(F.substring(F.md5(F.concat_ws(":", "role", F.col("nth").cast("string"), "text").cast("binary")), 1, 8), 16, 10).cast("long")
    said = said.select("conv_id", "turn", "role", "text", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(dealt, F.col("pieces"))).cast("long").alias("piece"), "nth")
    # the text meets each perspective once; a hot conversation's rows are split by Spark's skew join
    seen = said.join(who, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    own = F.col("role").eqNullSafe(F.col("perspective")) & F.col("perspective").isNotNull()
    head = F.when(own, F.lit("<|im_start|>assistant\n")).when(F.col("role") == "system", F.lit("<|im_start|>system\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), F.col("role"), F.lit("\n")))
    body = F.concat("text", F.lit("<|im_end|>\n"))
    seen = seen.select("conv_id", "perspective", "turn", "piece", "role", "text", "nth", head.alias("head"), body.alias("body"), own.alias("own"))
    seen = seen.withColumn("part", F.floor(F.greatest(F.col("turn"), F.lit(0)) / turns_per_part).cast("long"))
    at = Window.partitionBy("conv_id", "perspective", "part", "piece").orderBy("turn", "role", "text", "nth").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("start", F.coalesce(F.sum(F.char_length("head") + F.char_length("body")).over(at), F.lit(0)) + F.char_length("head"))
    span = F.when(F.col("own"), F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.char_length("body") - 1).cast("long").alias("end")))
    lines = seen.groupBy("conv_id", "perspective", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "nth", F.concat("head", "body").alias("said")))).alias("lines"), F.sort_array(F.collect_list(span)).alias("mask"))
    return lines.select(
        "conv_id", "perspective", "part", "piece", F.size("lines").cast("long").alias("n_turns"), F.array_join("lines.said", "").alias("rendered"), "mask",
        F.aggregate("mask", F.lit(0).cast("long"), lambda n, m: n + m["end"] - m["start"]).alias("n_masked"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return made.select("conv_id", "perspective", "part", "piece", "n_turns", "rendered", spans.alias("mask"), "n_masked")


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
), said AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role, text) - 1 AS nth, CAST(ceil(count(*) OVER (PARTITION BY conv_id, turn) / 256.0) AS BIGINT) AS pieces FROM rows
), who AS (
  SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'
), seen AS (
  SELECT s.conv_id, w.perspective, s.turn, s.role, s.text, s.nth, s.role = w.perspective AS own,
    CASE WHEN s.role = w.perspective THEN '<|im_start|>assistant' WHEN s.role = 'system' THEN '<|im_start|>system' ELSE '<|im_start|>user name=' || s.role END || chr(10) AS head,
    s.text || '<|im_end|>' || chr(10) AS body, greatest(s.turn, 0) // 256 AS part,
    CASE WHEN pieces > 1 THEN CAST('0x' || substr(md5(s.role || ':' || s.nth || ':' || s.text), 1, 8) AS BIGINT) % pieces ELSE 0 END AS piece
  FROM said s LEFT JOIN who w ON s.conv_id IS NOT DISTINCT FROM w.conv_id
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part, piece ORDER BY turn, role, text, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM seen
)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, CAST(piece AS BIGINT) AS piece, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn, role, text, nth) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN CAST(start AS BIGINT) || '-' || CAST(start + length(body) - 1 AS BIGINT) END, ',' ORDER BY start), '') AS mask,
  CAST(coalesce(sum(CASE WHEN own THEN length(body) - 1 END), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, perspective, part, piece
"""
