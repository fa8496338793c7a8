"""Operator 1 (native): preference formatting of chosen and rejected conversations.

A pair's turns meet in one shuffle, by pair. Higher-order functions sort them, find the longest common prefix of turns
(role and text alike), render it once as the prompt, and render what follows on each side as a completion with the
character spans that count for training (assistant turns). No Python runs on the executors and nothing is joined.

A null role or text renders as empty; nulls are alike. Turns with equal numbers are ordered by role and text; repeated
rows stay repeated turns. A pair that lacks one side has that side empty, an empty prompt and prefix 0. Rows with a
null pair or side are left out. If one conversation is a prefix of the other, its completion is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(turns: str) -> str:
    return f"concat('', array_join(transform({turns}, t -> t.piece), ''))"


def spans(turns: str) -> str:
    """``start-end`` of the text of each assistant turn within the rendered completion, comma-separated."""
    return f"""array_join(aggregate({turns}, named_struct('at', 0L, 'out', cast(array() as array<string>)),
        (s, t) -> named_struct('at', s.at + char_length(t.piece),
            'out', if(t.role = 'assistant', concat(s.out, array(concat(s.at + char_length(t.role) + 5, '-', s.at + char_length(t.piece)))), s.out)),
        s -> s.out), ',')"""


def preference_pairs(turns: DataFrame, pair: Column, side: Column) -> DataFrame:
    """One row per pair of ``turns(conv_id, turn, role, text)``.

    ``pair``: the pair a row belongs to. ``side``: 0 for the chosen conversation, 1 for the rejected one.
    Returns ``pair_id, chosen_id, rejected_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask``. A turn
    is ``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed; the mask covers text and end mark.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    piece = F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))
    rows = turns.select(pair.cast("long").alias("pair_id"), side.cast("int").alias("side"), "conv_id", F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), piece.alias("piece")).alias("t")).where("pair_id is not null and side in (0, 1)")
    pairs = rows.groupBy("pair_id").agg(
        F.min(F.when(F.col("side") == 0, F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(F.col("side") == 1, F.col("conv_id"))).alias("rejected_id"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 0, F.col("t")))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("side") == 1, F.col("t")))).alias("b"),
    )
    shorter = "least(size(a), size(b))"
    differs = f"filter(if({shorter} > 0, sequence(1, {shorter}), cast(array() as array<int>)), i -> a[i - 1].role <> b[i - 1].role or a[i - 1].piece <> b[i - 1].piece)"
    pairs = pairs.withColumn("n_prefix", F.expr(f"cast(coalesce(array_min({differs}) - 1, {shorter}) as bigint)"))
    pairs = pairs.withColumn("c", F.expr("slice(a, cast(n_prefix + 1 as int), size(a))")).withColumn("r", F.expr("slice(b, cast(n_prefix + 1 as int), size(b))"))
    return pairs.select(
        "pair_id", "chosen_id", "rejected_id", "n_prefix",
        F.expr(rendered("slice(a, 1, cast(n_prefix as int))")).alias("prompt"),
        F.expr(rendered("c")).alias("chosen"), F.expr(rendered("r")).alias("rejected"),
        F.expr(spans("c")).alias("chosen_mask"), F.expr(spans("r")).alias("rejected_mask"),
    )


#: The query: conversations 2k and 2k + 1 are a pair, the even one chosen.
ORACLE = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id, coalesce(role, '') AS role,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS piece,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT pair_id, min(CASE WHEN side = 0 THEN conv_id END) AS chosen_id, min(CASE WHEN side = 1 THEN conv_id END) AS rejected_id,
         least(coalesce(max(CASE WHEN side = 0 THEN k END), 0), coalesce(max(CASE WHEN side = 1 THEN k END), 0)) AS shorter
  FROM t GROUP BY pair_id),
d AS (
  SELECT a.pair_id, min(a.k) - 1 AS same FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1 AND a.k = b.k
  WHERE a.role <> b.role OR a.piece <> b.piece GROUP BY a.pair_id),
n AS (SELECT p.*, CAST(coalesce(d.same, p.shorter) AS BIGINT) AS n_prefix FROM p LEFT JOIN d USING (pair_id)),
s AS (
  SELECT t.*, n.n_prefix, coalesce(sum(CASE WHEN k > n.n_prefix THEN length(piece) ELSE 0 END)
         OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM t JOIN n USING (pair_id))
SELECT n.pair_id, n.chosen_id, n.rejected_id, n.n_prefix,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 0 AND k <= s.n_prefix), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 0 AND k > s.n_prefix), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY k) FILTER (WHERE side = 1 AND k > s.n_prefix), '') AS rejected,
  coalesce(string_agg(CAST(place + length(role) + 5 AS VARCHAR) || '-' || CAST(place + length(piece) AS VARCHAR), ',' ORDER BY k)
    FILTER (WHERE side = 0 AND k > s.n_prefix AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(place + length(role) + 5 AS VARCHAR) || '-' || CAST(place + length(piece) AS VARCHAR), ',' ORDER BY k)
    FILTER (WHERE side = 1 AND k > s.n_prefix AND role = 'assistant'), '') AS rejected_mask
FROM n JOIN s USING (pair_id) GROUP BY n.pair_id, n.chosen_id, n.rejected_id, n.n_prefix
"""
