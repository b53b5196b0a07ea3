"""Preference formatting: one prompt, two masked completions.

A pair names a chosen and a rejected conversation.  Their longest common prefix of turns, equal in role and text, is rendered once
as the prompt; what follows in each becomes its completion.  ``segments`` has one row per turn: ``mask`` is 1 where a model is trained
(assistant turns of completions) and 0 elsewhere.  ``paired`` puts them into one prompt and two completions with their masks, ``TURNS`` turns a
row, so that no conversation has to fit into one row.

Turns are aligned by their number.  The end of the prefix is the smallest number at which the two sides differ, an aggregate with
map-side sums: no window, and no conversation in one task.  Everything is DataFrame code.

Null turn numbers come before all others.  Null texts are empty, null roles are ``unknown``.  Several rows with one
turn number are one turn; they are compared as a bag, by their texts, and rendered in the order of role and content.  Pairs with an absent side are no
pairs.  Very long texts are rendered whole.  Other columns are not read, whatever their names.  Without turns the result is empty.  Identical conversations have a prompt and no completions.  Null conversation ids belong to no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"
#: Numbers of turns in a row of ``paired``.
TURNS = 256
_FIRST = -(1 << 31)


def adjacent(turns: DataFrame) -> DataFrame:
    """pair_id, conv_id, side: conversations 2k (chosen) and 2k + 1 (rejected) make pair k, if both exist."""
    ids = turns.select("conv_id").where("conv_id IS NOT NULL").distinct()
    pairs = ids.groupBy(F.floor(F.col("conv_id") / F.lit(2)).cast("long").alias("pair_id")).agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    sides = F.explode(F.array(F.struct((2 * F.col("pair_id")).alias("conv_id"), F.lit("chosen").alias("side")), F.struct((2 * F.col("pair_id") + 1).alias("conv_id"), F.lit("rejected").alias("side"))))
    return pairs.select("pair_id", sides.alias("s")).select("pair_id", "s.*")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def segments(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), turn, role, content, mask, n_prefix (turns of the prompt).

    ``turns`` needs conv_id, turn, role, text; ``pairs`` pair_id, conv_id, side (one row a side).
    """
    clean = turns.select("conv_id", F.coalesce("turn", F.lit(_FIRST)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = pairs.where("conv_id IS NOT NULL AND pair_id IS NOT NULL")
    rows = clean.join(both.select("pair_id", "conv_id", "side"), "conv_id")
    # Equal turns of both sides cancel out: the same role and text as often here as there.
    often = lambda side: F.count(F.when(F.col("side") == side, 1))
    cells = rows.groupBy("pair_id", "turn", "role", "text").agg(often("chosen").alias("_c"), often("rejected").alias("_r"))
    held = cells.groupBy("pair_id", "turn").agg(F.every(F.col("_c") == F.col("_r")).alias("_same"), F.max(F.col("_c") > 0).alias("_a"), F.max(F.col("_r") > 0).alias("_b"))
    split = held.groupBy("pair_id").agg(F.min(F.when(~F.col("_same"), F.col("turn"))).alias("_split"), F.max("_a").alias("_a"), F.max("_b").alias("_b")).where("_a AND _b")
    shared = held.join(split.select("pair_id", "_split"), "pair_id").where("_split IS NULL OR turn < _split").groupBy("pair_id").agg(F.count(F.lit(1)).alias("_n"))
    split = split.join(shared, "pair_id", "left").select("pair_id", "_split", F.coalesce("_n", F.lit(0)).alias("n_prefix"))
    out = rows.join(split, "pair_id")
    prompt = F.col("_split").isNull() | (F.col("turn") < F.col("_split"))
    out = out.where((F.col("side") == "chosen") | ~prompt)
    return out.select(
        "pair_id", F.when(prompt, "prompt").otherwise(F.col("side")).alias("part"), "turn", "role", rendered(F.col("role"), F.col("text")).alias("content"),
        F.when(~prompt & (F.col("role") == TRAINED), 1).otherwise(0).alias("mask"), "n_prefix",
    )


def paired(parts: DataFrame, turns: int = TURNS) -> DataFrame:
    """pair_id, piece, n_prefix, prompt, chosen, chosen_mask, rejected, rejected_mask: prompt and paired completions as strings.

    A mask names, segment by segment, whether it is trained on and its length in characters: ``1:25,0:12``.  Rows hold ``turns`` numbers
    of turns, so an ordinary conversation is one row and one of any length is several, in the order of ``piece``.
    """
    segment = F.struct("turn", "role", "content", "mask")
    of = lambda part: F.array_sort(F.collect_list(F.when(F.col("part") == part, segment))).alias(part)
    rows = parts.groupBy("pair_id", F.floor(F.col("turn") / turns).cast("long").alias("piece")).agg(F.max("n_prefix").alias("n_prefix"), *map(of, ("prompt", "chosen", "rejected")))
    text = lambda side: F.array_join(F.transform(side, lambda x: x["content"]), "")
    mask = lambda side: F.array_join(F.transform(side, lambda x: F.concat(x["mask"].cast("string"), F.lit(":"), F.length(x["content"]).cast("string"))), ",")
    return rows.select("pair_id", "piece", "n_prefix", *(c for side in ("prompt", "chosen", "rejected") for c in ([text(side).alias(side)] if side == "prompt" else [text(side).alias(side), mask(side).alias(f"{side}_mask")])))


#: DuckDB: turns compared as ordered lists.
SQL = f"""
WITH t AS (SELECT conv_id, conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side,
                  coalesce(turn, {_FIRST}) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT pair_id FROM t GROUP BY pair_id HAVING count(DISTINCT side) = 2),
b AS (SELECT pair_id, turn, list([role, text] ORDER BY role, text) FILTER (side = 'chosen') AS c,
             list([role, text] ORDER BY role, text) FILTER (side = 'rejected') AS r FROM t JOIN p USING (pair_id) GROUP BY ALL),
s AS (SELECT pair_id, min(CASE WHEN c IS DISTINCT FROM r THEN turn END) AS split FROM b GROUP BY pair_id),
n AS (SELECT pair_id, split, count(CASE WHEN split IS NULL OR turn < split THEN 1 END) AS n_prefix FROM b JOIN s USING (pair_id) GROUP BY ALL),
x AS (SELECT t.*, n_prefix, split IS NULL OR turn < split AS prompt FROM t JOIN n USING (pair_id)),
y AS (SELECT pair_id, floor(turn / {TURNS}.0)::BIGINT AS piece, n_prefix, turn, role, CASE WHEN prompt THEN 'prompt' ELSE side END AS part,
             '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS content, CASE WHEN NOT prompt AND role = '{TRAINED}' THEN '1' ELSE '0' END AS mask
      FROM x WHERE side = 'chosen' OR NOT prompt)
SELECT pair_id, piece, max(n_prefix) AS n_prefix, {", ".join(
    f"coalesce(string_agg(content, '' ORDER BY turn, role, content) FILTER (part = '{part}'), '') AS {part}"
    + (f", coalesce(string_agg(mask || ':' || length(content), ',' ORDER BY turn, role, content) FILTER (part = '{part}'), '') AS {part}_mask" if part != "prompt" else "")
    for part in ("prompt", "chosen", "rejected"))}
FROM y GROUP BY pair_id, piece
"""
