"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation, rendered once.

Catalyst expressions over one row per pair; each completion comes with a run-length loss mask in which
only assistant replies and their end markers count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's markers.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order of (turn, role, text); exact repeats of a turn count once.

    Null role and text count as empty; turns without a conv_id belong to no conversation and give none.
    """
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_set(one)).alias("turns"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def mask(turns: Column) -> Column:
    """Run lengths in characters of the rendered turns, 'flag:length' joined by commas; 1 for a reply and its end marker."""

    def runs(t: Column) -> Column:
        head, body = F.char_length(t["role"]) + len(START) + 1, F.char_length(t["text"]) + len(END)
        return F.when(t["role"] == ASSISTANT, F.concat(F.lit("0:"), head.cast("string"), F.lit(",1:"), body.cast("string"), F.lit(",0:1"))).otherwise(F.concat(F.lit("0:"), (head + body + 1).cast("string")))

    return F.array_join(F.transform(turns, runs), ",")


def common_turns(a: Column, b: Column) -> Column:
    """Leading turns with equal role and text in both."""
    least = F.least(F.size(a), F.size(b))
    differ = F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: (F.get(a, i - 1)["role"] == F.get(b, i - 1)["role"]) & (F.get(a, i - 1)["text"] == F.get(b, i - 1)["text"]))
    at = F.array_position(differ, False)
    return F.when(F.coalesce(least, F.lit(0)) < 1, F.lit(0)).when(at == 0, least).otherwise((at - 1).cast("int"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen_id, chosen_turns, rejected_id, rejected_turns) -> prompt and masked completions.

    A missing side is null: its turns count as none, so nothing is common, and its completion is null.
    """
    n = common_turns(F.col("chosen_turns"), F.col("rejected_turns"))
    cut = pairs.withColumn("n_prompt_turns", n)

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_prompt_turns") + 1, F.greatest(F.size(side) - F.col("n_prompt_turns"), F.lit(0)))

    return cut.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns",
        F.coalesce(render(F.slice("chosen_turns", F.lit(1), F.col("n_prompt_turns"))), F.lit("")).alias("prompt"),
        render(rest("chosen_turns")).alias("chosen"), mask(rest("chosen_turns")).alias("chosen_mask"),
        render(rest("rejected_turns")).alias("rejected"), mask(rest("rejected_turns")).alias("rejected_mask"),
    )


def paired_by_id(turns: DataFrame) -> DataFrame:
    """The convention for an unlabelled table: conversations 2k and 2k + 1 are the chosen and rejected of pair k."""
    each = conversations(turns).withColumn("pair_id", F.floor(F.col("conv_id") / 2).cast("long"))
    even = F.pmod(F.col("conv_id"), F.lit(2)) == 0

    def side(is_side: Column, c: str) -> Column:
        return F.first(F.when(is_side, F.col(c)), ignorenulls=True)

    return each.groupBy("pair_id").agg(side(even, "conv_id").alias("chosen_id"), side(even, "turns").alias("chosen_turns"), side(~even, "conv_id").alias("rejected_id"), side(~even, "turns").alias("rejected_turns"))


def preferences(turns: DataFrame) -> DataFrame:
    """Every conversation of the table in one preference row (see paired_by_id and format_pairs)."""
    return format_pairs(paired_by_id(turns))


PREFERENCES_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, conv_id // 2 AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
c AS (SELECT * FROM n WHERE conv_id % 2 = 0), r AS (SELECT * FROM n WHERE conv_id % 2 <> 0),
same AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k, coalesce(c.role = r.role AND c.text = r.text, false) AS eq
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.k = r.k),
p AS (SELECT pair_id, coalesce(min(k) FILTER (NOT eq) - 1, max(k)) AS n_prompt_turns FROM same GROUP BY pair_id),
d AS (
  SELECT n.*, p.n_prompt_turns, '{START}' || role || chr(10) || text || '{END}' || chr(10) AS s,
    CASE WHEN role = '{ASSISTANT}' THEN '0:' || (length(role) + {len(START) + 1}) || ',1:' || (length(text) + {len(END)}) || ',0:1'
         ELSE '0:' || (length(role) + length(text) + {len(START) + len(END) + 2}) END AS m
  FROM n JOIN p USING (pair_id))
SELECT pair_id, max(conv_id) FILTER (conv_id % 2 = 0) AS chosen_id, max(conv_id) FILTER (conv_id % 2 <> 0) AS rejected_id, CAST(max(n_prompt_turns) AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY k) FILTER (conv_id % 2 = 0 AND k <= n_prompt_turns), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY k) FILTER (conv_id % 2 = 0 AND k > n_prompt_turns), CASE WHEN count(*) FILTER (conv_id % 2 = 0) > 0 THEN '' END) AS chosen,
  coalesce(string_agg(m, ',' ORDER BY k) FILTER (conv_id % 2 = 0 AND k > n_prompt_turns), CASE WHEN count(*) FILTER (conv_id % 2 = 0) > 0 THEN '' END) AS chosen_mask,
  coalesce(string_agg(s, '' ORDER BY k) FILTER (conv_id % 2 <> 0 AND k > n_prompt_turns), CASE WHEN count(*) FILTER (conv_id % 2 <> 0) > 0 THEN '' END) AS rejected,
  coalesce(string_agg(m, ',' ORDER BY k) FILTER (conv_id % 2 <> 0 AND k > n_prompt_turns), CASE WHEN count(*) FILTER (conv_id % 2 <> 0) > 0 THEN '' END) AS rejected_mask
FROM d GROUP BY pair_id
"""
