"""Preference formatting of conversations (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The turn markers of the rendered text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))


def render(turns: Column) -> Column:
    """One string of an array of turns (role, text)."""
    return F.array_join(F.transform(turns, _turn), "")


def mask(turns: Column, trained: str) -> Column:
    """Half-open character ranges of the rendered turns that bear loss: text and closing marker of each turn of role `trained`."""
    head = F.lit(len(OPEN) + 1)

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head + F.length(t["role"])
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.when(t["role"] == trained, F.array(F.struct(begin.alias("begin"), end.alias("end")))).otherwise(none)
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    none = F.array().cast("array<struct<begin:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def preference(turns: DataFrame, pair: Column, rejected: Column, turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """Pairs of a chosen and a rejected conversation as one prompt and two masked completions.

    turns has a row a turn; `pair` names its pair and `rejected` is true for turns of the rejected
    side. The longest common prefix of turns, equal in role and text, is rendered once as prompt;
    what follows on each side is its completion, with the character ranges that bear loss.

    Returns pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask; masks
    are arrays of (begin, end) into the completion. One shuffle, by pair; a row holds two whole
    conversations, which is what the format asks for, and no other grouping takes place.

    Turns whose pair or side is null belong to no conversation and take no part; a null turn
    number comes first; a null role or text is rendered empty. Turns of equal number stand by role,
    then text; repeated turns stay. If one side is missing or a prefix of the other, its completion
    is empty with an empty mask; two equal conversations share all turns. Extra columns are ignored.
    An empty table gives no rows.
    """
    t = turns.select(pair.alias("pair_id"), rejected.alias("_rejected"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_turn"))
    sides = t.where("pair_id IS NOT NULL AND _rejected IS NOT NULL").groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("_rejected"), F.col("_turn")))).alias("_c"),
        F.sort_array(F.collect_list(F.when(F.col("_rejected"), F.col("_turn")))).alias("_r"))
    same = F.zip_with("_c", "_r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    differs = F.array_position(same, F.lit(False))
    x = sides.withColumn("n_prompt_turns", F.when(differs > 0, differs - 1).otherwise(F.size("_c")).cast("int"))
    rest = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.greatest(F.size(side) - F.col("n_prompt_turns"), F.lit(0)))
    x = x.withColumns({"_p": F.slice("_c", F.lit(1), F.col("n_prompt_turns")), "_c": rest("_c"), "_r": rest("_r")})
    return x.select("pair_id", "n_prompt_turns", render(F.col("_p")).alias("prompt"), render(F.col("_c")).alias("chosen"), render(F.col("_r")).alias("rejected"),
                    mask(F.col("_c"), trained).alias("chosen_mask"), mask(F.col("_r"), trained).alias("rejected_mask"))


PREFERENCE_SQL = f"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT pair_id FROM t),
n AS (SELECT p.pair_id,
        (SELECT count(*) FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.pos = r.pos AND c.role = r.role AND c.text = r.text
         WHERE c.pair_id = p.pair_id AND c.side = 0 AND r.side = 1
           AND NOT EXISTS (SELECT 1 FROM t c2 JOIN t r2 ON c2.pair_id = r2.pair_id AND c2.pos = r2.pos AND c2.side = 0 AND r2.side = 1
                           WHERE c2.pair_id = p.pair_id AND c2.pos < c.pos AND (c2.role <> r2.role OR c2.text <> r2.text)))::INT AS k FROM p),
u AS (SELECT t.*, k, '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS shown,
        sum(CASE WHEN pos > k THEN {len(OPEN) + len(CLOSE) + 2} + length(role) + length(text) ELSE 0 END)
          OVER (PARTITION BY t.pair_id, side ORDER BY pos) AS until
      FROM t JOIN n USING (pair_id)),
v AS (SELECT *, CASE WHEN pos > k AND role = 'assistant' THEN (until - 1 - length(text) - {len(CLOSE)})::BIGINT::VARCHAR || '-' || (until - 1)::BIGINT::VARCHAR END AS span FROM u)
SELECT pair_id::BIGINT AS pair_id, any_value(k) AS n_prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 0 AND pos <= k), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 0 AND pos > k), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 1 AND pos > k), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 0 AND span IS NOT NULL), '') AS chosen_mask,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 1 AND span IS NOT NULL), '') AS rejected_mask
FROM v GROUP BY pair_id
"""
