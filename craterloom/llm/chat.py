"""Preference formatting with DataFrame functions only: one shared prompt, two masked completions.

Two conversations form a preference pair: the chosen one and the rejected one.  Their longest common
prefix of turns (same turn number, role and text) is rendered once as the prompt; what follows is
rendered on either side as a completion.  A loss mask marks the characters that a model is trained
on: the contents of assistant turns of a completion and their end marker.

The result is long: a pair's *prompt* rows hold the prompt and nothing else, its *completion* rows the
two completions side by side, whatever a conversation's length.  A part's text is the texts of its
rows in the order of ``seq``; a row holds the turns of one block of ``block_turns`` turn numbers, so
most pairs have one row of each part, and no task ever gathers a long conversation: turns are dealt by
pair and block, and only one small row for each block is gathered by pair.

Defined results
---------------
* A null conversation id, turn number or pair belongs to no conversation: such rows form no pair.
* A null role counts as ``user``, a null text as empty.
* Repeated rows of one turn count once; of different ones the smallest (role, text) stands.
* A conversation without a partner has no prompt; its completion rows have a null other side.
* Without a common prefix a pair has no prompt row; two equal conversations have prompt rows only.
* A side without turns in a block is null there.
* An empty table gives no rows.  Columns besides the four named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BLOCK_TURNS = 256


def _rendered(side: Column) -> Column:
    """Turns as one string; null where the side has none in this block."""
    turns = F.array_sort(side)
    text = F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit("\n"), t.text, F.lit(CLOSE))), "")
    return F.when(F.size(side) > 0, text)


def _mask(side: Column, trained_role: str) -> Column:
    """Runs ``weight:length`` in characters, comma-joined: header 0, then the content and end marker."""
    def runs(t: Column) -> Column:
        return F.concat(
            F.lit("0:"), (F.length(t.role) + len(OPEN) + 1).cast("string"),
            F.when(t.role == trained_role, ",1:").otherwise(",0:"), (F.length(t.text) + len(CLOSE)).cast("string"),
        )

    return F.when(F.size(side) > 0, F.array_join(F.transform(F.array_sort(side), runs), ","))


def format_preferences(
    conversations: DataFrame,
    pair: Column,
    chosen: Column,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained_role: str = "assistant",
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """Pairs of conversations as prompt and masked completions.

    ``pair`` and ``chosen`` are expressions over a row: the pair's id, and whether the row is of the
    chosen side.  Returns pair_id, part (``prompt`` or ``completion``), seq (from 0 in each part), turns
    (turn numbers in this row), prompt, chosen, chosen_mask, rejected, rejected_mask, prompt_end (the
    first turn after the prompt; null where nothing follows), side (``both``, ``chosen`` or ``rejected``:
    the sides that have turns).
    """
    said = F.struct(F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = conversations.where(F.col(conv_id).isNotNull() & F.col(turn).isNotNull()).select(
        pair.alias("pair_id"), F.col(turn).cast("long").alias("turn"), chosen.alias("is_chosen"), said.alias("said")
    )
    number = lambda c: F.expr(f"({c} - pmod({c}, {block_turns})) div {block_turns}")  # noqa: E731  rounded down, in whole numbers
    rows = rows.withColumn("block", number("turn")).where("pair_id is not null and block is not null")  # said here, so that both uses share one exchange
    turns = rows.groupBy("pair_id", "block", "turn").agg(
        F.min(F.when(F.col("is_chosen"), F.col("said"))).alias("c"), F.min(F.when(~F.col("is_chosen"), F.col("said"))).alias("r")
    )
    # one small row for each block, and from these one for each pair
    blocks = turns.groupBy("pair_id", "block").agg(
        F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("turn"))).alias("end"),
        F.max(F.col("c").isNotNull()).alias("has_c"), F.max(F.col("r").isNotNull()).alias("has_r"),
    )
    ends = blocks.groupBy("pair_id").agg(F.min("end").alias("end"), F.max("has_c").alias("has_c"), F.max("has_r").alias("has_r"))
    known = blocks.select("pair_id", "block").join(ends, "pair_id")
    placed = turns.join(known, ["pair_id", "block"])
    in_prompt = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    part = F.when(in_prompt, "prompt").otherwise("completion")
    seq = F.when(in_prompt, F.col("block")).otherwise(F.col("block") - number("end"))
    piece = lambda side, when: F.collect_list(F.when(when & F.col(side).isNotNull(), F.struct("turn", F.col(side).role.alias("role"), F.col(side).text.alias("text"))))
    grouped = placed.groupBy("pair_id", "block", part.alias("part")).agg(
        F.first(seq).alias("seq"), F.count("*").alias("turns"), F.first("end").alias("prompt_end"),
        piece("c", in_prompt).alias("p"), piece("c", ~in_prompt).alias("c"), piece("r", ~in_prompt).alias("r"),
        F.first("has_c").alias("has_c"), F.first("has_r").alias("has_r"),
    )
    return grouped.select(
        "pair_id", "part", "seq", "turns", _rendered(F.col("p")).alias("prompt"),
        _rendered(F.col("c")).alias("chosen"), _mask(F.col("c"), trained_role).alias("chosen_mask"),
        _rendered(F.col("r")).alias("rejected"), _mask(F.col("r"), trained_role).alias("rejected_mask"), "prompt_end",
        F.when(F.col("has_c") & F.col("has_r"), "both").when(F.col("has_c"), "chosen").otherwise("rejected").alias("side"),
    )


def op1_preference_format(spark, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as preference pairs, over the whole table."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    conv_id = F.col("conv_id").cast("long")
    return format_preferences(conv, F.shiftright(conv_id, 1), conv_id.bitwiseAND(F.lit(1)) == 0)


ORACLE = """
WITH said AS (
  SELECT (CAST(conv_id AS BIGINT) - (conv_id & 1)) // 2 AS pair_id, CAST(turn AS BIGINT) AS turn, conv_id & 1 = 0 AS is_chosen,
         {'role': coalesce(role, 'user'), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
turns AS (
  SELECT pair_id, turn, min(said) FILTER (WHERE is_chosen) AS c, min(said) FILTER (WHERE NOT is_chosen) AS r
  FROM said GROUP BY pair_id, turn),
ends AS (
  SELECT pair_id, min(turn) FILTER (WHERE c IS DISTINCT FROM r) AS stop, bool_or(c IS NOT NULL) AS has_c, bool_or(r IS NOT NULL) AS has_r
  FROM turns GROUP BY pair_id),
placed AS (
  SELECT t.pair_id, turn, c, r, has_c, has_r, stop, stop IS NULL OR turn < stop AS in_prompt,
         CAST(floor(turn / 256.0) AS BIGINT) AS block, CAST(floor(stop / 256.0) AS BIGINT) AS stop_block
  FROM turns t JOIN ends e ON t.pair_id = e.pair_id),
shown AS (
  SELECT *, '<|im_start|>' || c.role || chr(10) || c.text || '<|im_end|>' || chr(10) AS c_text,
         '<|im_start|>' || r.role || chr(10) || r.text || '<|im_end|>' || chr(10) AS r_text,
         '0:' || (length(c.role) + 13) || (CASE WHEN c.role = 'assistant' THEN ',1:' ELSE ',0:' END) || (length(c.text) + 11) AS c_mask,
         '0:' || (length(r.role) + 13) || (CASE WHEN r.role = 'assistant' THEN ',1:' ELSE ',0:' END) || (length(r.text) + 11) AS r_mask
  FROM placed)
SELECT pair_id, CASE WHEN in_prompt THEN 'prompt' ELSE 'completion' END AS part,
       CASE WHEN in_prompt THEN block ELSE block - stop_block END AS seq, CAST(count(*) AS BIGINT) AS turns,
       string_agg(c_text, '' ORDER BY turn) FILTER (WHERE in_prompt) AS prompt,
       string_agg(c_text, '' ORDER BY turn) FILTER (WHERE NOT in_prompt AND c IS NOT NULL) AS chosen,
       string_agg(c_mask, ',' ORDER BY turn) FILTER (WHERE NOT in_prompt AND c IS NOT NULL) AS chosen_mask,
       string_agg(r_text, '' ORDER BY turn) FILTER (WHERE NOT in_prompt AND r IS NOT NULL) AS rejected,
       string_agg(r_mask, ',' ORDER BY turn) FILTER (WHERE NOT in_prompt AND r IS NOT NULL) AS rejected_mask,
       any_value(stop) AS prompt_end,
       CASE WHEN any_value(has_c) AND any_value(has_r) THEN 'both' WHEN any_value(has_c) THEN 'chosen' ELSE 'rejected' END AS side
FROM shown GROUP BY pair_id, in_prompt, block, stop_block
"""
