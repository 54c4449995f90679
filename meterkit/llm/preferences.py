"""Preference formatting: one prompt and two masked completions per pair.

Chosen and rejected conversations are aligned turn by turn. Their longest
common turn prefix is rendered once as the prompt; what follows on each side
is a completion with the spans a trainer learns from (the bodies of assistant
turns and their end marks). Everything is a DataFrame expression: one shuffle
brings a pair's turns together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template of a turn. A text cannot fake a mark: its "<|" becomes "< |".
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>"
TRAINED_ROLE = "assistant"


def _body(x: str) -> str:
    return f"replace({x}.text, '<|', '< |')"


def _head(x: str) -> str:
    return f"concat('{OPEN}', {x}.role, '{CLOSE}')"


def _render(turns: str) -> str:
    return f"concat_ws('', transform({turns}, x -> concat({_head('x')}, {_body('x')}, '{END}\n')))"


def _mask(turns: str, role: str) -> str:
    """SQL for the trained spans (start, length) of rendered ``turns``, in
    characters."""
    size = f"length({_head('x')}) + length({_body('x')}) + {len(END) + 1}"
    span = f"named_struct('start', a.at + length({_head('x')}), 'length', length({_body('x')}) + {len(END)})"
    return (f"aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,length:int>>)),"
            f" (a, x) -> named_struct('at', a.at + {size}, 'spans', if(x.role = '{role}', concat(a.spans, array({span})), a.spans)),"
            " a -> a.spans)")


def format_pairs(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per pair of ``turns`` (pair_id, is_chosen, turn, role, text):
    ``pair_id``, ``prompt``, ``chosen``, ``rejected``, ``chosen_mask``,
    ``rejected_mask`` (arrays of start and length in characters),
    ``prompt_turns``, ``chosen_turns``, ``rejected_turns`` (numbers of turns).

    Turns are taken in the order (turn, role, text), so ties and repeated turn
    numbers have a fixed order; a row that is repeated whole is a turn of its
    own. A null role or text is empty, a null turn comes first. Rows with a
    null pair_id or is_chosen belong to no pair. Equal sides have empty
    completions; a side without turns has an empty completion and the prompt
    is empty. An empty table gives an empty result; other columns are not
    looked at. A pair's turns become one row, so they meet in one task.
    """
    if "'" in trained_role or "\\" in trained_role:
        raise ValueError("trained_role may not hold quotes")
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = (turns.where("pair_id is not null and is_chosen is not null").groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_chosen"), one))).alias("c"),
        F.array_sort(F.collect_list(F.when(~F.col("is_chosen"), one))).alias("r")))
    # turn numbers order the sides; they are no part of what is compared
    plain = "transform({0}, x -> named_struct('role', x.role, 'text', x.text))"
    sides = sides.withColumns({s: F.expr(plain.format(s)) for s in ("c", "r")})
    both = "least(size(c), size(r))"
    differs = f"array_position(transform(slice(c, 1, {both}), (x, i) -> x = r[i]), false)"
    sides = sides.withColumn("k", F.expr(f"cast(if({differs} = 0, {both}, {differs} - 1) as int)"))
    rest = {s: f"slice({s}, k + 1, greatest(size({s}) - k, 0))" for s in ("c", "r")}
    return sides.select(
        "pair_id", F.expr(_render("slice(c, 1, k)")).alias("prompt"), F.expr(_render(rest["c"])).alias("chosen"),
        F.expr(_render(rest["r"])).alias("rejected"), F.expr(_mask(rest["c"], trained_role)).alias("chosen_mask"),
        F.expr(_mask(rest["r"], trained_role)).alias("rejected_mask"), F.col("k").alias("prompt_turns"),
        F.expr("size(c) - k").alias("chosen_turns"), F.expr("size(r) - k").alias("rejected_turns"))


def swapped_answers(conversations: DataFrame) -> DataFrame:
    """Pairs made of conversations (conv_id, turn, role, text), as ``format_pairs``
    takes them: chosen is a conversation as it is; rejected has the text of its
    last assistant turn exchanged for that of its neighbour (ids 2k and 2k + 1
    are neighbours), or lacks that turn where the neighbour has none. The last
    turn is the one with the largest (turn, text)."""
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    last = (turns.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id")
            .agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last")))
    other = last.select(F.col("conv_id").bitwiseXOR(1).alias("conv_id"), F.col("last.text").alias("other"))
    ends = last.join(other, "conv_id", "left")
    # one row per conversation on this side; the turns keep their own shuffle
    joined = turns.join(ends, "conv_id", "left")
    is_last = F.coalesce((F.col("role") == TRAINED_ROLE) & F.col("turn").eqNullSafe(F.col("last.turn"))
                         & (F.coalesce("text", F.lit("")) == F.col("last.text")), F.lit(False))
    sides = joined.withColumn("is_last", is_last).withColumn("is_chosen", F.explode(F.array(F.lit(True), F.lit(False))))
    sides = sides.where("is_chosen or not is_last or other is not null")
    return sides.select(F.col("conv_id").alias("pair_id"), "is_chosen", "turn", "role",
                        F.when(F.col("is_chosen") | ~F.col("is_last"), F.col("text")).otherwise(F.col("other")).alias("text"))
