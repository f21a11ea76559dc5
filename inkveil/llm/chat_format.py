"""Multi-party chat formatting, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once more with that speaker as the assistant and
everybody else as named users. A rendered dialogue stays a row per turn, with its place in the whole and the place of
what the assistant says (the loss mask), so a conversation of any length is never gathered in one row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Roles that give instructions and are nobody's perspective.
INSTRUCTIONS = ("system",)
#: Turns that one window adds up; offsets of longer conversations are carried from block to block.
BLOCK = 256


#: The beginning of the marks that part turns (a fixed value of the format), and what stands for it in names and texts.
MARK, SHOWN = "<|im_", "<| im_"


def harmless(text: Column) -> Column:
    """A text in which no mark can begin, so that nobody's words can end a turn or begin another's."""
    return F.replace(text, F.lit(MARK), F.lit(SHOWN))


def segment(role: Column, name: Column, text: Column) -> tuple[Column, Column, Column]:
    """What stands before a turn's text, the text, and what stands behind it."""
    head = F.concat(F.lit("<|im_start|>"), role, F.coalesce(F.concat(F.lit(" name="), F.translate(harmless(name), "\n\r", "  ")), F.lit("")), F.lit("\n"))
    return head, harmless(F.coalesce(text, F.lit(""))), F.lit("<|im_end|>\n")


def rotate_perspectives(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """For every conversation, participant (perspective) and turn a row: conv_id, perspective, turn, chat_role, name,
    segment, mask, char_start, char_end, mask_start, mask_end.

    segment is the turn as rendered, char_start and char_end its place in the rendered dialogue (the segments of a
    conversation and perspective in order), mask 1 where the perspective speaks; then mask_start and mask_end are the
    place of its words and the closing mark, else null. Instructions stay as they are and are no perspective. Turns
    are ordered by turn (null first), then by speaker and text; rows that repeat stay. A null speaker is no
    participant and is rendered as a user without a name, a null text as an empty one; a null conversation is left
    out, as nobody can tell which turns belong together. The beginning of a mark in a text or name is written with a space,
    line ends in names too. Other columns of df are left out, so none can clash. An empty table gives an empty result.
    """
    rows = df.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(speaker).cast("string").alias("role"), F.col(text).cast("string").alias("text")).filter("conv_id is not null")
    heads = rows.filter(F.col("role").isNotNull() & ~F.col("role").isin(*INSTRUCTIONS)).groupBy("conv_id", F.col("role").alias("perspective")).agg(F.lit(1).alias("_")).drop("_")
    seen = rows.join(heads, "conv_id")
    mine = F.col("role").eqNullSafe(F.col("perspective"))
    told = F.coalesce(F.col("role").isin(*INSTRUCTIONS), F.lit(False))
    chat_role = F.when(told, F.col("role")).when(mine, "assistant").otherwise("user")
    name = F.when(~told & ~mine, F.col("role"))
    seen = seen.select("conv_id", "perspective", "turn", "role", "text", chat_role.alias("chat_role"), name.alias("name"), mine.cast("int").alias("mask"), F.floor(F.coalesce("turn", F.lit(-(1 << 40))) / BLOCK).alias("block"))
    head, body, tail = segment(F.col("chat_role"), F.col("name"), F.col("text"))
    seen = seen.withColumns({"segment": F.concat(head, body, tail), "head": F.length(head)}).withColumn("size", F.length("segment").cast("long"))
    within = W.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = seen.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("all")).withColumn("carried", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all").filter("carried > 0")
    ends = seen.withColumn("end", F.sum("size").over(within)).join(blocks, ["conv_id", "perspective", "block"], "left")
    end = F.col("end") + F.coalesce("carried", F.lit(0))
    start = end - F.col("size")
    spoken = F.col("mask") == 1
    return ends.select("conv_id", "perspective", "turn", "chat_role", "name", "segment", "mask", start.alias("char_start"), end.alias("char_end"), F.when(spoken, start + F.col("head")).alias("mask_start"), F.when(spoken, end - 1).alias("mask_end"))
