"""Multi-party dialogues as training text, once from the perspective of every participant.

For each participant of a conversation the dialogue is rendered with that speaker as assistant and
the others as users who carry their names; system turns stay system turns. Only the chosen
speaker's words (and the marker that ends them) count for the loss. The result is one segment for
each perspective and turn, with its place in the rendered dialogue, so a conversation of any length
is never gathered in one row; ``dialogues`` joins the segments where that is wanted.

Defined results
- A null text is empty; a null role is the participant ``unknown``; a null conversation id is a
  conversation of its own; a null turn comes first.
- Turns of equal number are ordered by role and text; repeated rows stay, as turns of their own.
- A conversation without participants other than ``system`` has no perspective and no rows.
- Markers of the template inside a text are broken up (``<|`` becomes ``< |``), so a text can't
  start a turn; line breaks in a role are spaces in the header.
- Texts of any length are rendered whole; a segment holds one turn.
- Rows without a conversation id, or of one id, are one conversation of any length: its turns are summed in blocks of
  ``BLOCK`` turn numbers. Turns of one number (or none) are one block.
- An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"
#: Turns of a conversation whose lengths are summed together before their sums are.
BLOCK = 1024


def name(role: Column) -> Column:
    """A role as it stands in a header: in one line."""
    return F.regexp_replace(plain(role), r"[\r\n]+", " ")


def plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def perspectives(turns: DataFrame) -> DataFrame:
    """One row for each perspective and turn.

    ``conv_id, assistant, turn, turn_no, speaker, role, segment, start, loss_start, end``: the
    segment lies at ``[start, end)`` in code points of the dialogue; ``[loss_start, end - 1)`` of it
    counts for the loss (both null where nothing does: the closing line break never does).
    """
    speaker = F.coalesce(F.col("role"), F.lit(UNKNOWN))
    rows = turns.select(
        F.col("conv_id"), F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("_conv"),
        F.col("turn"), speaker.alias("speaker"), plain(F.col("text")).alias("_content"),
    )
    voices = rows.where(F.col("speaker") != SYSTEM).select("_conv", F.col("speaker").alias("assistant")).distinct()
    seen = rows.join(voices, "_conv")
    own, system = F.col("speaker") == F.col("assistant"), F.col("speaker") == SYSTEM
    role = F.when(system, SYSTEM).when(own, "assistant").otherwise("user")
    head = F.concat(F.lit(OPEN), role, F.when(system | own, F.lit("")).otherwise(F.concat(F.lit(" name="), name(F.col("speaker")))), F.lit("\n"))
    seen = seen.withColumns({"role": role, "_head": F.length(head), "segment": F.concat(head, F.col("_content"), F.lit(CLOSE + "\n"))})
    # Blocks of turns are summed on their own; a block's order is the turns', so sums of blocks add up.
    seen = seen.withColumn("_block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1 << 62))).withColumn("_length", F.length("segment").cast("long"))
    key = ["_conv", "assistant"]
    blocks = seen.groupBy(*key, "_block").agg(F.sum("_length").alias("_all"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*key, "_block", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_chars"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_turns"))
    inside = Window.partitionBy(*key, "_block").orderBy("turn", "speaker", "_content").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumns({"_sum": F.sum("_length").over(inside), "_no": F.count(F.lit(1)).over(inside)}).join(blocks, [*key, "_block"])
    end = F.col("_chars") + F.col("_sum")
    start = end - F.col("_length")
    return seen.select(
        "conv_id", "assistant", "turn", (F.col("_turns") + F.col("_no") - 1).alias("turn_no"), "speaker", "role", "segment", start.alias("start"),
        F.when(F.col("role") == "assistant", start + F.col("_head")).alias("loss_start"), end.alias("end"),
    )


def dialogues(turns: DataFrame) -> DataFrame:
    """``conv_id, assistant, text, masks`` with masks as ``[start, end)`` pairs: for conversations that fit a row."""
    rows = perspectives(turns)
    part = F.struct("turn_no", "segment", F.when(F.col("loss_start").isNotNull(), F.struct(F.col("loss_start").alias("start"), (F.col("end") - 1).alias("end"))).alias("mask"))
    parts = F.sort_array(F.collect_list(part))
    return rows.groupBy("conv_id", "assistant").agg(parts.alias("_parts")).select(
        "conv_id", "assistant", F.concat_ws("", F.col("_parts.segment")).alias("text"), F.filter(F.col("_parts.mask"), lambda m: m.isNotNull()).alias("masks")
    )
